"""Schemas that drift from file to file: versioned fingerprints, a list of every change, one consistent table.

1. ``field_profiles`` reads each file's records once and keeps, per field, how many records carry it, its JSON type and
   what it holds: the median of its numbers and a MinHash signature of its values (both merge across partitions).
2. ``schema_versions`` fingerprints the fields and types of each file and numbers the versions of a feed: one begins where
   the fingerprint changes.
3. ``migration_steps`` turns each pair of consecutive versions into explicit steps: added, removed, retyped, renamed. A
   field that goes while one of the same quantity comes is a renaming; pairs are made closest first. The steps are the
   report of changes.
4. ``migration_rules`` chains the steps from a feed's newest version back: for each version's fields the latest name and
   the type that they are cast to, for fields that it lacks a default. ``migrate`` routes every record through the rules
   of its file's version into one table of one schema: a row per post, and per entry of a query with its position and name.

Work per file is bounded by the number of fields of a file, never by its records, so one feed may hold most rows; what
follows the order of a feed's versions streams in that order and holds one version.

Defined cases: null or broken JSON, and JSON that is no object (nor, in queries, an array), carries nothing but counts as
a record; a record without a feed or file number can't be ordered and takes part in no comparison, but is migrated by its
own names; NaN and Infinity are not JSON; of a repeated key the last counts; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.readings import spread
from chronoloom.session import ensure_checkpoint_dir

#: A file has a field if at least one of so many of its records carries it.
CARRIED_BY = 5
#: Two fields hold the same quantity if their medians differ by less than this factor.
SAME_LEVEL = 2.0
#: ... or, where values are words, if their sets are at least so similar.
SAME_WORDS = 0.5
HASHES = 16
CONTAINER = "fields"
#: Members that name an entry of an array.
NAMES = ("field", "name")
_SEEDS = [zlib.crc32(f"words {k}".encode()) for k in range(HASHES)]
FILE = ["table_name", "feed", "file_no"]
RECORDS = "table_name string, feed string, file_no long, rec_id long, kind string, body string"


def _no_constant(name: str):
    raise ValueError(name)


def _decode(text: str | None):
    """The JSON value of a text; None for null, broken or too deep."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def number_in(value) -> float | None:
    """The number that a value holds: itself, a numeric text, the first of an array, or the measured member of an object."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float, str)):
        try:
            x = float(value)
        except (ValueError, OverflowError):
            return None
        return x if math.isfinite(x) else None
    if isinstance(value, list):
        return number_in(value[0]) if value and not isinstance(value[0], (list, dict)) else None
    for key in ("v", "value"):
        if key in value and not isinstance(value[key], (list, dict)):
            return number_in(value[key])
    return next((x for x in (number_in(v) for v in value.values() if not isinstance(v, (list, dict))) if x is not None), None)


def fields_of(kind: str, text: str | None) -> dict[str, list]:
    """Non-null values by field of one record: top-level keys of a post, keys of the entries (and the container) of a query."""
    value = _decode(text)
    if kind == "post":
        return {k: [v] for k, v in value.items() if v is not None} if isinstance(value, dict) else {}
    if not isinstance(value, (dict, list)):
        return {}
    out: dict[str, list] = {CONTAINER: [value]}
    for entry in value.values() if isinstance(value, dict) else value:
        if isinstance(entry, dict):
            for k, v in entry.items():
                if v is not None:
                    out.setdefault(k, []).append(v)
    return out


def _leaves(value) -> Iterator[str]:
    """The words in a value, whatever arrays or objects hold them."""
    if isinstance(value, (list, dict)):
        for x in value if isinstance(value, list) else value.values():
            yield from _leaves(x)
    else:
        yield value if isinstance(value, str) else json.dumps(value)


def _word_hashes(word: str) -> tuple[int, ...]:
    base = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return tuple((base * (2 * s + 1) + s) & 0xFFFFFFFF for s in _SEEDS)


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes: dict[str, tuple[int, ...]] = {}

    def signature(values: list) -> list[int]:
        """MinHash of the words in the values: of each hash function the least over the words."""
        found = []
        for word in {w for v in values for w in _leaves(v)} or {""}:
            if word not in hashes:
                if len(hashes) > 50_000:
                    hashes.clear()
                hashes[word] = _word_hashes(word)
            found.append(hashes[word])
        return list(found[0]) if len(found) == 1 else [min(column) for column in zip(*found)]

    for pdf in batches:
        # A file's records are counted in a row without field.
        counted = Counter(zip(pdf.table_name, pdf.feed, pdf.file_no))
        rows = [(*file, None, "", n, 0, None, None) for file, n in counted.items()]
        for table, feed, file_no, kind, body in zip(pdf.table_name, pdf.feed, pdf.file_no, pdf.kind, pdf.body):
            for field, values in fields_of(kind, body).items():
                kinds: dict[str, list] = {}
                for v in values:
                    kinds.setdefault(json_type(v), []).append(v)
                for k, (type_, own) in enumerate(kinds.items()):
                    worded = kind != "post" and field != CONTAINER or type_ in ("string", "boolean")
                    numbers = [] if field == CONTAINER and kind != "post" else [x for x in map(number_in, own) if x is not None]
                    rows.append((table, feed, file_no, field, type_, int(k == 0), len(own), median(numbers) if numbers else None, signature(own) if worded else None))
        yield pd.DataFrame(rows, columns=["table_name", "feed", "file_no", "field", "json_type", "carries", "n_values", "number", "words"]).astype({"file_no": "Int64"})


def records(raw_posts: DataFrame, raw_queries: DataFrame) -> DataFrame:
    """Both raw tables as one of RECORDS' columns; kind is post or query."""
    one = lambda df, table, key, kind, body: df.select(F.lit(table).alias("table_name"), "feed", "file_no", F.col(key).alias("rec_id"), F.lit(kind).alias("kind"), F.col(body).alias("body"))
    return spread(one(raw_posts, "raw_posts", "post_id", "post", "value_text").unionByName(one(raw_queries, "raw_queries", "query_id", "query", "fields_text")))


def files(typed: DataFrame) -> DataFrame:
    """Each file with its number of records, its ordinal in the feed, from 1, and the feed's next file (null at the end)."""
    counted = typed.where(F.col("field").isNull()).select(*FILE, F.col("carries").alias("n_records"))
    ordered = Window.partitionBy("table_name", "feed").orderBy("file_no")
    return counted.withColumns({"ordinal": F.row_number().over(ordered), "next_file_no": F.lead("file_no").over(ordered)})


def field_profiles(recs: DataFrame) -> DataFrame:
    """One row per file and field that the file has: ordinal, json_type, level, words (MinHash) and n_distinct; and one without field per file."""
    schema = "table_name string, feed string, file_no long, field string, json_type string, carries int, n_values int, number double, words array<long>"
    long = recs.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).mapInPandas(_profile, schema)
    mins = [F.min(F.col("words")[k]).alias(f"w{k}") for k in range(HASHES)]
    typed = long.groupBy(*FILE, "field", "json_type").agg(F.sum("carries").alias("carries"), F.sum("n_values").alias("n_values"), F.count("number").alias("n_numbers"), F.percentile_approx("number", 0.5, 1000).alias("level"), F.approx_count_distinct("number").alias("n_distinct"), *mins)
    # Some rows a file: the records are read once.
    ensure_checkpoint_dir(recs.sparkSession)
    typed = typed.checkpoint()
    # Of types as frequent the first by name counts; the median is that of the most frequent type.
    rank = F.struct(F.col("n_values"), -F.ascii("json_type"), -F.length("json_type"))
    by_field = typed.where(F.col("field").isNotNull()).groupBy(*FILE, "field").agg(
        F.sum("carries").alias("carries"),
        F.max_by(F.struct("json_type", "level", "n_values", "n_numbers", "n_distinct"), rank).alias("main"),
        F.array(*(F.min(f"w{k}") for k in range(HASHES))).alias("words"),
    )
    every = files(typed)
    held = by_field.join(every, FILE).where(F.col("carries") * CARRIED_BY >= F.col("n_records")).select(*FILE, "ordinal", "next_file_no", "field", "main.json_type", F.when(F.col("main.n_numbers") * 2 >= F.col("main.n_values"), F.col("main.level")).alias("level"), "main.n_values", "main.n_distinct", "words")
    # A file may have no field; it is a file all the same.
    return held.unionByName(every.select(*FILE, "ordinal", "next_file_no"), allowMissingColumns=True)


def schema_versions(profiles: DataFrame) -> DataFrame:
    """Of each file its schema (fields and types), that schema's fingerprint, the feed's version that it belongs to, and whether it is the version's first and last."""
    named = F.when(F.col("field").isNotNull(), F.concat_ws(":", "field", "json_type"))
    prints = profiles.groupBy(*FILE, "ordinal", "next_file_no").agg(F.array_sort(F.collect_list(named)).alias("schema_fields"))
    feed = Window.partitionBy("table_name", "feed").orderBy("ordinal")
    first = F.coalesce(F.lag("schema_fields").over(feed) != F.col("schema_fields"), F.lit(True))
    last = F.coalesce(F.lead("schema_fields").over(feed) != F.col("schema_fields"), F.lit(True))
    marked = prints.withColumns({"first": first, "last": last})
    return marked.withColumns({"schema_version": F.sum(F.col("first").cast("long")).over(feed), "fingerprint": F.hex(F.xxhash64("schema_fields"))})


def _distance(a: dict, b: dict, worded: bool) -> float | None:
    """How far two fields' contents lie apart; None if they don't hold the same quantity. worded: numbers may be words of a small set."""
    # Nulls in an array of integers come as NaN.
    words = lambda x: None if x["words"] is None or any(w is None or w != w for w in x["words"]) else list(x["words"])
    wa, wb = words(a), words(b)
    alike = sum(x == y for x, y in zip(wa, wb)) / HASHES if wa and wb else None
    if a["level"] is not None and b["level"] is not None:
        x, y = a["level"], b["level"]
        near = 0.0 if x == y else abs(math.log(x / y)) if x * y > 0 else math.inf
        if near >= math.log(SAME_LEVEL):
            return None
        few = worded and max(a["n_distinct"], b["n_distinct"]) <= 12 and alike is not None
        return None if few and alike < SAME_WORDS else near
    if a["level"] is None and b["level"] is None and alike is not None and alike >= SAME_WORDS:
        return 1 - alike
    return None


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for table, feed, file_no, ordinal, version, old, new in zip(pdf.table_name, pdf.feed, pdf.file_no, pdf.ordinal, pdf.schema_version, pdf.old, pdf.new):
            old, new = ({x["field"]: x for x in (x if isinstance(x, dict) else x.asDict() for x in xs)} for xs in (old, new))
            at = (table, feed, file_no, ordinal, version)
            gone, come = [x for f, x in old.items() if f not in new], [x for f, x in new.items() if f not in old]
            near = sorted((d, a["field"], b["field"]) for a in gone for b in come if (d := _distance(a, b, table == "raw_queries")) is not None)
            used_a: set[str] = set()
            used_b: set[str] = set()
            for _, a, b in near:
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    rows.append((*at, "renamed", a, b))
            rows += [(*at, "removed", a["field"], "") for a in gone if a["field"] not in used_a]
            rows += [(*at, "added", "", b["field"]) for b in come if b["field"] not in used_b]
            rows += [(*at, "retyped", f, f) for f, x in new.items() if f in old and old[f]["json_type"] != x["json_type"]]
        yield pd.DataFrame(rows, columns=["table_name", "feed", "file_no", "ordinal", "schema_version", "change_kind", "field_from", "field_to"])


def migration_steps(profiles: DataFrame, versions: DataFrame) -> DataFrame:
    """The steps from each version of a feed to the next, at the file that begins it: table_name, feed, file_no, ordinal, schema_version, change_kind, field_from, field_to."""
    edges = profiles.where(F.col("field").isNotNull()).join(versions.where(F.col("first") | F.col("last")).select(*FILE, "schema_version", "first", "last"), FILE)
    # The last file of a version is what the next one's first file is compared with.
    at = lambda when, version, file_no, ordinal, side: F.when(when, F.struct(version.alias("schema_version"), file_no.alias("file_no"), ordinal.alias("ordinal"), F.lit(side).alias("side")))
    version, ordinal = F.col("schema_version"), F.col("ordinal")
    sides = F.array_compact(F.array(at(F.col("first") & (version > 1), version, F.col("file_no"), ordinal, "new"), at(F.col("last") & F.col("next_file_no").isNotNull(), version + 1, F.col("next_file_no"), ordinal + 1, "old")))
    content = F.struct("field", "json_type", "level", "n_distinct", "words").alias("content")
    of = lambda side: F.array_compact(F.collect_list(F.when(F.col("e.side") == side, F.col("content")))).alias(side)
    pairs = edges.select("table_name", "feed", F.explode(sides).alias("e"), content).groupBy("table_name", "feed", "e.file_no", "e.ordinal", "e.schema_version").agg(of("old"), of("new"))
    return pairs.mapInPandas(_match, "table_name string, feed string, file_no long, ordinal int, schema_version long, change_kind string, field_from string, field_to string")


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rules of each version, from rows sorted by feed and version, the newest first; holds the names and types of one version."""
    feed, names, targets = None, {}, {}
    for pdf in batches:
        rows = []
        for table, name, version, fields, steps in zip(pdf.table_name, pdf.feed, pdf.schema_version, pdf.fields, pdf.steps):
            if (table, name) != feed:
                feed, names, targets = (table, name), {}, {}
            rules = {}
            for x in fields if fields is not None else ():
                latest = names.get(x["field"], x["field"])
                # The newest version that has a field tells what it holds.
                target = targets.setdefault(latest, "number" if x["json_type"] == "number" or x["numeric"] else "text")
                rules[x["field"]] = (latest, target)
            rows.append((table, name, version, json.dumps(rules), [latest for latest, _ in rules.values()], [targets[latest] for latest, _ in rules.values()]))
            steps = [(x["change_kind"], x["field_from"], x["field_to"]) for x in (steps if steps is not None else ())]
            renamed = {old: names.get(new, new) for kind, old, new in steps if kind == "renamed"}
            # Before this version a name that came or went meant nothing of what it means later.
            for kind, old, new in steps:
                names.pop(old if kind == "removed" else new, None)
            names |= renamed
        yield pd.DataFrame(rows, columns=["table_name", "feed", "schema_version", "rules", "latest", "targets"])


def migration_rules(profiles: DataFrame, versions: DataFrame, steps: DataFrame) -> DataFrame:
    """Per feed and version: rules (JSON: field to latest name and the type that it is cast to) and defaults (JSON: the feed's other fields and their types)."""
    by = ["table_name", "feed", "schema_version"]
    firsts = profiles.join(versions.where("first").select(*FILE, "schema_version"), FILE)
    fields = firsts.groupBy(*by).agg(F.array_compact(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "json_type", F.col("level").isNotNull().alias("numeric"))))).alias("fields"))
    taken = steps.groupBy(*by).agg(F.collect_list(F.struct("change_kind", "field_from", "field_to")).alias("steps"))
    ordered = fields.join(taken, by, "left").repartition("table_name", "feed").sortWithinPartitions("table_name", "feed", F.col("schema_version").desc())
    chained = ordered.mapInPandas(_chain, "table_name string, feed string, schema_version long, rules string, latest array<string>, targets array<string>")
    every = chained.select("table_name", "feed", F.explode(F.arrays_zip("latest", "targets")).alias("x")).groupBy("table_name", "feed").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set("x")))).alias("defaults"))
    return chained.select(*by, "rules").join(every, ["table_name", "feed"], "left")


def entries_of(kind: str, value) -> list[tuple]:
    """Position, name and non-null members of each entry of a decoded record; a post, and a query without entries, is one without position.

    An entry's name is its key in the object, or else the first of NAMES that it has; an entry that is no object is a member of the container's name.
    """
    if kind == "post" or not value or not isinstance(value, (dict, list)):
        members = value if kind == "post" and isinstance(value, dict) else {}
        return [(None, None, {k: v for k, v in members.items() if v is not None})]
    out = []
    for pos, (name, entry) in enumerate(value.items() if isinstance(value, dict) else ((None, e) for e in value)):
        members = {k: v for k, v in (entry if isinstance(entry, dict) else {CONTAINER: entry}).items() if v is not None}
        if name is None and isinstance(entry, dict):
            name = next((members[k] for k in NAMES if isinstance(members.get(k), str)), None)
        out.append((pos, name, members))
    return out


def _latest_names(fields, rules: dict) -> dict:
    """Latest name of each field of one record; a field whose latest name another one has keeps its own."""
    kept = {f for f in fields if rules.get(f, f) == f}
    while True:
        out = {f: f if f in kept else rules[f] for f in fields}
        taken: set[str] = set()
        for f in sorted(fields, key=lambda f: f not in kept):
            if out[f] in taken:
                kept.add(f)
                break
            taken.add(out[f])
        else:
            return out


def _left_by_cast(value):
    """What the number in a value leaves of it: further elements or members, the whole object if its key tells what was measured."""
    if isinstance(value, list):
        return value[1:]
    if isinstance(value, dict):
        measured = next((k for k in ("v", "value") if k in value and not isinstance(value[k], (list, dict))), None)
        return value if measured is None else {k: x for k, x in value.items() if k != measured}
    return None


class _Rules:
    """Rules and defaults by their JSON, read once each while they are few."""

    def __init__(self):
        self.known: dict[str, dict] = {}

    def of(self, text: str | None) -> dict:
        if not isinstance(text, str):
            return {}
        if text not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[text] = json.loads(text)
        return self.known[text]


def _apply(defaults: dict[tuple[str, str], float | str | None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _Rules()
        for pdf in batches:
            rows = []
            for table, feed, file_no, rec_id, kind, body, version, rules, others in zip(pdf.table_name, pdf.feed, pdf.file_no, pdf.rec_id, pdf.kind, pdf.body, pdf.schema_version, pdf.rules, pdf.defaults):
                rules, others = read.of(rules), read.of(others)
                if kind != "post":
                    # The container isn't a field of an entry.
                    rules = {f: r for f, r in rules.items() if f != CONTAINER}
                latest = {f: r[0] for f, r in rules.items()}
                decoded = _decode(body)
                for pos, entry, members in entries_of(kind, decoded):
                    numbers, texts, applied = {}, {}, []
                    names = _latest_names(members, latest)
                    for field, value in members.items():
                        name = names[field]
                        if name != field:
                            applied.append(f"rename:{field}>{name}")
                        elif latest.get(field, field) != field:
                            applied.append(f"clash:{field}>{latest[field]}")
                        # A field without a rule, as in records that no file's schema covers, goes by its own type.
                        target = others.get(name) or ("number" if json_type(value) == "number" else "text" if name in others else None)
                        x = number_in(value) if target != "text" else None
                        if x is None:
                            texts[name] = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
                            if target == "number":
                                applied.append(f"uncast:{name}")
                            elif target == "text" and json_type(value) in ("number", "boolean"):
                                applied.append(f"cast:{name}")
                            continue
                        numbers[name] = x
                        if json_type(value) != "number":
                            applied.append(f"cast:{name}")
                            if left := _left_by_cast(value):
                                texts[name] = json.dumps(left, sort_keys=True)
                    known = numbers.keys() | texts.keys() | (set(NAMES) if entry is not None else set())
                    for name, target in others.items():
                        if name not in known and not (name == CONTAINER and kind != "post"):
                            (numbers if target == "number" else texts)[name] = defaults.get((table, name))
                            applied.append(f"default:{name}")
                    rows.append((table, feed, file_no, rec_id, pos, entry, "read" if decoded is not None else "broken", version, numbers, texts, applied))
            yield pd.DataFrame(rows, columns=["table_name", "feed", "file_no", "rec_id", "entry_pos", "entry_name", "read_status", "schema_version", "numbers", "texts", "applied"]).astype({"file_no": "Int64", "rec_id": "Int64", "entry_pos": "Int64", "schema_version": "Int64"})

    return run


def migrate(recs: DataFrame, rules: DataFrame, versions: DataFrame, defaults: dict[tuple[str, str], float | str | None] | None = None) -> DataFrame:
    """Every record, a query by its entries, in one schema: numbers and texts by the latest field names, and the rules that were applied.

    defaults: value of (table, field) where a record lacks a field of its feed's schema; null where none is given. What a
    cast to a number leaves of an array or object is in texts, as JSON, beside the number; what can't be cast is there whole.
    """
    of_file = versions.select(*FILE, "schema_version").join(rules, ["table_name", "feed", "schema_version"], "left")
    out = "table_name string, feed string, file_no long, rec_id long, entry_pos long, entry_name string, read_status string, schema_version long, numbers map<string,double>, texts map<string,string>, applied array<string>"
    return recs.join(of_file, FILE, "left").mapInPandas(_apply(defaults or {}), out)


def drift_report(raw_posts: DataFrame, raw_queries: DataFrame) -> DataFrame:
    """Every change of both raw tables' feeds; see ``migration_steps``."""
    profiles = field_profiles(records(raw_posts, raw_queries))
    return migration_steps(profiles, schema_versions(profiles))


def consistent_table(raw_posts: DataFrame, raw_queries: DataFrame, defaults: dict[tuple[str, str], float | str | None] | None = None) -> DataFrame:
    """All records of both raw tables in one schema; see ``migrate``."""
    recs = records(raw_posts, raw_queries)
    profiles = field_profiles(recs)
    versions = schema_versions(profiles)
    return migrate(recs, migration_rules(profiles, versions, migration_steps(profiles, versions)), versions, defaults)
