"""Sources and sinks of the analyses: explicit schemas, checked rows, whole-file writes."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = "id BIGINT, type STRING, name STRING, canonical STRING, cached_count BIGINT, merger_id STRING"
WORKS = "creation_date STRING, language STRING, restricted STRING, complete STRING, word_count STRING, tags STRING, tail STRING"


def _csv(spark: SparkSession, path: str, schema: str, header: list[str], one_line: bool = False) -> DataFrame:
    """A CSV file with doubled quotes whose header must be as given; line feeds in fields make a file one task's, unless there are none."""
    first = spark.read.text(path).first()
    names = [x.strip().strip('"') for x in (first[0] if first else "").lstrip("﻿").split(",")]
    if names[: len(header)] != header or any(names[len(header) :]):
        raise ValueError(f"unexpected header: {names}")
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=not one_line, enforceSchema=True, mode="FAILFAST").csv(path)


def read_tags(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """The tag dump; a malformed row is an error when it is read.  With ``one_line`` (no line feeds in names) a file is split over tasks."""
    raw = _csv(spark, path, TAGS, ["id", "type", "name", "canonical", "cached_count", "merger_id"], one_line)
    link = F.col("merger_id").try_cast("bigint")
    bad = (F.coalesce(F.col("id"), F.lit(0)) <= 0) | ~F.coalesce(F.col("canonical").isin("true", "false"), F.lit(False)) | F.col("cached_count").isNull() | (
        F.col("merger_id").isNotNull() & F.coalesce(link <= 0, F.lit(True))
    )
    checked = raw.withColumn("id", F.when(bad, F.raise_error(F.lit("malformed tag row")).cast("bigint")).otherwise(F.col("id")))
    return checked.select(
        "id", "type", F.coalesce("name", F.lit("")).alias("name"), (F.col("canonical") == "true").alias("canonical"), "cached_count",
        link.alias("merger_id")
    )


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """The works dump with ``ordinal``, the 1-based number of the record in the file, and tags as an array of ids.

    The ordinal needs the file's order: one file is read by one task, as
    records may hold line feeds.  Sources with a key of their own do not need it.
    """
    raw = _csv(spark, path, WORKS, ["creation date", "language", "restricted", "complete", "word_count", "tags"])
    numbered = raw.coalesce(1).withColumn("ordinal", F.monotonically_increasing_id() + 1)
    words = F.when(F.trim("word_count") != "", F.trim("word_count"))
    bad = ~F.coalesce(
        F.col("restricted").isin("true", "false") & F.col("complete").isin("true", "false"), F.lit(False)
    ) | F.col("tail").isNotNull() | (words.isNotNull() & words.try_cast("bigint").isNull()) | (words.try_cast("bigint") < 0)
    checked = numbered.withColumn("ordinal", F.when(bad, F.raise_error(F.lit("malformed work row")).cast("bigint")).otherwise(F.col("ordinal")))
    ids = F.transform(F.split(F.coalesce("tags", F.lit("")), "[+]"), lambda x: x.try_cast("bigint"))
    return checked.select(
        "ordinal", F.col("creation_date").cast("date"), "language", (F.col("restricted") == "true").alias("restricted"),
        (F.col("complete") == "true").alias("complete"), words.try_cast("bigint").alias("word_count"),
        F.array_distinct(F.filter(ids, lambda x: x.isNotNull())).alias("tags")
    )


def work_tags(works: DataFrame) -> DataFrame:
    return works.select("ordinal", F.explode("tags").alias("tag_id"))


def read_xml_tags(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Tags.xml file."""
    rows = spark.read.format("xml").option("rowTag", "row").schema("_Id BIGINT, _TagName STRING, _Count BIGINT").load(path)
    return rows.select(F.col("_Id").alias("id"), F.col("_TagName").alias("name"), F.col("_Count").alias("question_count"))


def read_pages(spark: SparkSession, path: str, items: str) -> DataFrame:
    """Items of cached response pages ({"items": [...], "has_more": ..., "quota_remaining": ...}), with ``page`` and ``place``.

    The pages' numbers, at the end of their files' names, must follow each other
    from 1 on without a gap, only the last may say that it is the last, and the
    quota, where it is given, must not rise from page to page.
    """
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json(?:\.gz)?$", 1).cast("bigint")
    pages = spark.read.schema(
        f"items ARRAY<STRUCT<{items}>>, has_more BOOLEAN, quota_remaining BIGINT"
    ).option("multiLine", True).json(path).withColumn("page", number)
    last = ~F.coalesce("has_more", F.lit(False))
    found = pages.agg(
        F.count("*").alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.count_distinct("page").alias("d"),
        F.count_if(last).alias("ends"), F.max(F.when(last, F.col("page"))).alias("end")
    ).first()
    if found["ends"] != 1 or (found["lo"], found["d"], found["hi"], found["end"]) != (1, found["n"], found["n"], found["n"]):
        raise ValueError("the cached pages are incomplete or out of order")
    given = pages.filter("quota_remaining IS NOT NULL").select("page", "quota_remaining")
    before = given.select((F.col("page") + 1).alias("page"), F.col("quota_remaining").alias("before"))
    if not given.join(before, "page").filter("quota_remaining > before").isEmpty():
        raise ValueError("the quota rises: pages of several runs are mixed")
    return pages.select("page", F.posexplode("items").alias("place", "item")).select("item.*", "page", "place")


# ---------------------------------------------------------------- vectors --
def decode_base64_vectors(responses: DataFrame, column: str = "embedding", dimensions: int = 1536) -> DataFrame:
    """Little-endian float32 vectors from base64; a vector of another length, not finite or zero is an error."""
    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        import base64

        out = []
        for x in s:
            v = np.frombuffer(base64.b64decode(x, validate=True), "<f4")
            if len(v) != dimensions or not np.isfinite(v).all() or not v.any():
                raise ValueError("invalid vector")
            out.append(v)
        return pd.Series(out)

    return responses.withColumn(column, decode(column))


def decode_json_vectors(responses: DataFrame, column: str = "embedding", dimensions: int = 1536) -> DataFrame:
    from ..functions.vectors import is_valid

    v = F.from_json(column, "array<float>")
    return responses.withColumn(column, v).withColumn(
        column, F.when(is_valid(column, dimensions), F.col(column)).otherwise(F.raise_error(F.lit("invalid vector")).cast("array<float>"))
    )


def check_indices(responses: DataFrame, expected: int, index: str = "index") -> None:
    """Indices 0..expected-1, each once."""
    r = responses.agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if (r["n"], r["d"]) != (expected, expected) or (expected and (r["lo"], r["hi"]) != (0, expected - 1)):
        raise ValueError("missing or repeated indices")


def by_index(responses: DataFrame, requests: DataFrame, expected: int, index: str = "index") -> DataFrame:
    """``requests`` with the rest of the response that names their index, whatever order responses came in; each index answers once."""
    check_indices(responses, expected, index)
    return requests.join(responses, index)


def plan_batches(texts: DataFrame, order: str, text: str, most: int = 512, most_bytes: int = 280_000) -> DataFrame:
    """Adds ``batch``: contiguous batches in order, each within both bounds; a larger text is an error.

    Greedy by nature, so one ordered pass: rows are cut into ranges that are
    planned apart (batches end at their borders), so no task sees all rows.
    """
    sized = texts.withColumn("_b", F.octet_length(text)).repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    schema = T.StructType([*texts.schema.fields, T.StructField("batch", T.StringType())])

    def plan(frames):
        k, count, size = -1, most, 0
        for f in frames:
            batch = np.empty(len(f), object)
            for i, b in enumerate(f["_b"]):
                if b > most_bytes:
                    raise ValueError("a text is larger than a batch")
                if count >= most or size + b > most_bytes:
                    k, count, size = k + 1, 0, 0
                count, size = count + 1, size + b
                batch[i] = f"{f['_p'].iloc[i]:06d}-{k:08d}"
            f["batch"] = pd.Series(batch, index=f.index)
            yield f.drop(columns=["_b", "_p"])

    return sized.mapInPandas(plan, schema)


def distinct_texts(*frames: DataFrame, text: str = "text") -> DataFrame:
    """(text_id, text): each text once; the id is its SHA-256, so it needs no global order."""
    rows = frames[0].select(text)
    for f in frames[1:]:
        rows = rows.union(f.select(text))
    return rows.distinct().select(F.sha2(F.col(text).cast("binary"), 256).alias("text_id"), text)


# ------------------------------------------------------------------ sinks --
def write_table(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    """Write under Spark's commit protocol; booleans in CSV are true and false."""
    defaults = {"csv": {"header": True, "quote": '"', "escape": '"'}, "json": {"compression": "gzip"}}.get(format, {})
    df.write.mode("overwrite").options(**(defaults | options)).format(format).save(path)


def write_counted(df: DataFrame, path: str, format: str = "csv", **options) -> dict[str, object]:
    """Write, and say what was written: rows, files, bytes, and a digest of the files' digests in the order of their names."""
    spark = df.sparkSession
    write_table(df, path, format, **options)
    back = spark.read.schema(df.schema)
    rows = (back.options(header=True, quote='"', escape='"', multiLine=True).csv(path) if format == "csv" else back.format(format).load(path)).count()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")
    )
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: x["sha256"]), "")
    found = files.agg(  # one digest a file
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(each.cast("binary"), 256).alias("sha256")
    ).first()
    return {"rows": rows, **found.asDict()}


def write_rankings(df: DataFrame, path: str, about: dict[str, object]) -> dict[str, object]:
    """Rankings as gzipped JSON lines, and beside them ``<path>.meta``: what they are and what was written."""
    spark = df.sparkSession
    written = write_counted(df, path, "json")
    line = json.dumps({"about": about, "written": written}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")
    return written


def read_rankings(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict[str, object]]:
    """Rankings and what they are; an error if the number of rows is not the one that was written."""
    meta = json.loads(spark.read.text(f"{path}.meta").first()[0])
    rows = spark.read.schema(schema).json(path)
    if rows.count() != meta["written"]["rows"]:
        raise ValueError("the rankings are not those that were written")
    return rows, meta["about"]


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------- driver-side files --
def fingerprint(value: object) -> str:
    """SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def ordered_fingerprint(value: object) -> str:
    """SHA-256 of JSON in the order given."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_json(path: str | Path, value: object) -> None:
    """Write beside the target, then replace it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
    os.replace(name, path)


class VerifiedStore:
    """A JSON file for one result that can prove what it was made from and that nobody has changed it."""

    #: Names of the file's parts.
    MADE_FROM, DIGEST, RESULT = "recipe_sha256", "result_sha256", "result"

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _envelope(self, recipe: object, result: object) -> dict[str, object]:
        return {self.MADE_FROM: fingerprint(recipe), self.DIGEST: fingerprint(result), self.RESULT: result}

    def put(self, recipe: object, result: object) -> None:
        write_json(self.path, self._envelope(recipe, result))

    def get(self, recipe: object) -> object:
        """The result, if the file is what ``put`` would write for it and this recipe; an error otherwise."""
        with self.path.open(encoding="utf-8") as f:
            held = json.load(f)
        result = held.get(self.RESULT)
        if held != self._envelope(recipe, result):
            raise ValueError(f"{self.path.name} was made from something else, or changed")
        return result

    def put_once(self, value: object) -> None:
        """Write a bare value that stays: the same again is nothing new, another one an error."""
        try:
            with self.path.open(encoding="utf-8") as f:
                same = fingerprint(json.load(f)) == fingerprint(value)
        except FileNotFoundError:
            write_json(self.path, value)
            return
        if not same:
            raise ValueError(f"{self.path.name} holds another value already")


def cache_folder(root: str | Path, recipe: object) -> Path:
    return Path(root) / fingerprint(recipe)[:20]


def checked_table(spark: SparkSession, root: str, recipe: object, make) -> DataFrame:
    """A table under a folder named by its recipe: made once, read afterwards."""
    path = f"{str(root).rstrip('/')}/{fingerprint(recipe)[:20]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def editable_csv(path: str | Path, fields: list[str], ids: list[str]) -> bool:
    """Start a reviewer's file with one blank row per id; an existing one is kept if its fields and ids are right."""
    import csv

    path = Path(path)
    if path.exists():
        with path.open(encoding="utf-8", newline="") as f:
            rows = csv.DictReader(f)
            found = [r[fields[0]] for r in rows]
            if rows.fieldnames != fields or sorted(found) != sorted(ids):
                raise ValueError("the file has other fields or ids")
        return False
    with path.open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(fields)
        out.writerows([i, *[""] * (len(fields) - 1)] for i in ids)
    return True


#: What a reviewer may judge, and how sure.
JUDGMENTS, CONFIDENCE = ("", "synonym", "new_canonical", "unresolved"), ("", "high", "medium", "low")
REVIEW_FIELDS = ("source_id", "reviewer", "judgment", "canonical_id", "proposed_name", "confidence", "catalogue_checked", "rationale")


def write_review_page(path: str | Path, title: str, packet: object, cases: list[dict[str, object]] | None = None) -> None:
    """One offline page: a search over names and aliases and, for given cases, a form for each that keeps its answers in the browser and exports them as CSV.

    Markup in the data stays text: it is never read as HTML, by the page or by its parser.
    """
    safe = lambda x: json.dumps(x, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    head = title.replace("&", "&amp;").replace("<", "&lt;")
    form = {
        "cases": cases or [], "fields": REVIEW_FIELDS,
        "choices": {"judgment": JUDGMENTS, "confidence": CONFIDENCE, "catalogue_checked": ("", "yes", "no")},
        "packet": fingerprint([cases or [], packet])
    }
    Path(path).write_text(
        f"""<!doctype html><meta charset="utf-8"><title>{head}</title><h1>{head}</h1><input id="q" placeholder="words, or #id"><p id="n"></p><ol id="r"></ol><section id="f"></section>
<script type="application/json" id="d">{safe(packet)}</script>
<script type="application/json" id="c">{safe(form)}</script>
<script>
const read = id => JSON.parse(document.getElementById(id).textContent), rows = read('d'), form = read('c');
const make = (name, text) => {{ const e = document.createElement(name); if (text !== undefined) e.textContent = text; return e; }};
const show = () => {{
  const q = document.getElementById('q').value.trim().toLowerCase(), words = q.split(/\\s+/);
  const hit = rows.filter(r => q.startsWith('#') ? String(r.id) === q.slice(1) : words.every(w => [r.name, ...(r.aliases || [])].join(' ').toLowerCase().includes(w)));
  document.getElementById('n').textContent = hit.length + ' found, first 100 shown';
  document.getElementById('r').replaceChildren(...hit.slice(0, 100).map(r => make('li', r.id + ' ' + r.name)));
}};
document.getElementById('q').oninput = show; show();
const place = 'review-' + form.packet, kept = JSON.parse(localStorage.getItem(place) || '{{}}');
const answer = c => kept[c.source_id] ||= Object.fromEntries(form.fields.map(f => [f, f === 'source_id' ? String(c.source_id) : '']));
const entry = (c, f) => {{
  const e = make(form.choices[f] ? 'select' : 'input');
  (form.choices[f] || []).forEach(v => e.append(make('option', v)));
  e.value = answer(c)[f]; e.readOnly = f === 'source_id'; e.name = f;
  e.onchange = () => {{ answer(c)[f] = e.value; localStorage.setItem(place, JSON.stringify(kept)); }};
  const label = make('label', f + ' '); label.append(e); return label;
}};
document.getElementById('f').append(...form.cases.map(c => {{
  const box = make('fieldset'); box.append(make('legend', c.source_id + ' ' + c.name), ...form.fields.map(f => entry(c, f))); return box;
}}));
if (form.cases.length) {{
  const b = make('button', 'Export CSV'), cell = v => '"' + String(v).replaceAll('"', '""') + '"';
  b.onclick = () => {{
    const lines = [form.fields, ...form.cases.map(c => form.fields.map(f => answer(c)[f]))].map(r => r.map(cell).join(',')).join('\\n') + '\\n';
    const a = make('a'); a.href = URL.createObjectURL(new Blob([lines], {{type: 'text/csv'}})); a.download = 'judgments.csv'; a.click();
  }};
  document.getElementById('f').append(b);
}}
</script>
""",
        encoding="utf-8",
    )
