"""Fill-in-middle training texts: DuckDB inside ``mapInArrow``, batch by batch.

A text is cut into units (a word with the white space before it; white space at the end).  Two draws from a hash of the
doc_id choose where the prefix and the middle end, two more whether the text stays plain and in which order the parts
stand.  Each Arrow batch is registered with an in-memory DuckDB, one SQL statement cuts, slices and joins the units
(``regexp_extract_all``, ``list_slice``, ``array_to_string``, ``sha256``), and its Arrow result goes back: no row is
touched in Python.  The stage is narrow, so a lost executor costs its tasks.

Units start with white space (but for the first) and hold no marker, so a marker in the output is never made up of
ends of its neighbours: ``restore`` cuts at the markers and puts the text together again.

Defined results: null text counts as empty and stays plain; a null doc_id draws from the empty string; rows that repeat
a doc_id draw alike, each on its own text; a very long text goes through DuckDB by itself, whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import give_back
from veilstream.llm.token_store import _slices

#: What stands before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 42
#: percent of the texts that are cut, and percent of these whose suffix comes first
CUT, SUFFIX_FIRST = 50, 80
#: a word with the white space before it, or white space alone
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: bytes of text that DuckDB holds as lists of units at a time (a longer text goes by itself)
SLICE_BYTES = 8 << 20
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def statement(relation: str, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> str:
    """DuckDB SQL over a relation (doc_id, text)."""
    before, after, mid = map(_literal, markers)
    draw = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(text, {m})" for m in (before, after, mid))
    joined = lambda a, b: f"coalesce(array_to_string(list_slice(units, {a}, {b}), ''), '')"
    return f"""
        WITH read AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {relation}
        ), unit AS (
            SELECT *, regexp_extract_all(text, {_literal(UNIT)}) AS units FROM read
        ), drawn AS (
            SELECT *, len(units) AS n, {draw(0)} % (len(units) + 1) AS one, {draw(1)} % (len(units) + 1) AS two,
                CASE WHEN text = '' OR {marked} OR {draw(2)} % 100 >= {cut} THEN 'plain' WHEN {draw(3)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
            FROM unit
        ), plain AS (
            SELECT doc_id, n, form, NULL AS prefix_chars, NULL AS middle_chars, text AS output FROM drawn WHERE form = 'plain'
        ), parts AS (
            SELECT doc_id, n, form, {joined(1, "least(one, two)")} AS prefix, {joined("least(one, two) + 1", "greatest(one, two)")} AS middle, {joined("greatest(one, two) + 1", "n")} AS suffix
            FROM drawn WHERE form <> 'plain'
        ), cut AS (
            SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
                CASE form WHEN 'psm' THEN {before} || prefix || {after} || suffix ELSE {after} || suffix || {before} || prefix END || {mid} || middle AS output
            FROM parts
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, output
        FROM (SELECT * FROM plain UNION ALL SELECT * FROM cut)
    """


def transform(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Per document of docs (doc_id, text): n units, form (plain, psm, spm), length of prefix and middle, output."""
    sql = statement("batch", seed, cut, suffix_first, markers)

    def run(batches):
        import duckdb

        with duckdb.connect(":memory:") as db:
            db.execute("SET threads = 1")
            db.execute("SET temp_directory = ''")  # a slice is held in memory; nothing goes to a local folder
            for batch in batches:
                for a, b in _slices(batch["text"], SLICE_BYTES):
                    db.register("batch", pa.Table.from_batches([batch.slice(a, b - a)]))
                    out = db.sql(sql).to_arrow_table()
                    db.unregister("batch")
                    yield from out.cast(_ARROW).to_batches()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, RESULT)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(map(re.escape, markers)), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def digest(transformed: DataFrame) -> DataFrame:
    """What ``transform`` gives, with hashes of the output and of the text rebuilt from it instead of the output."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL for the digests over documents, by places in the text instead of lists of units."""
    draw = lambda i: f"CAST('0x' || substr(sha256('42:' || doc_id), {8 * i + 1}, 8) AS BIGINT)"
    return rf"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '{UNIT}'), lambda u: length(u)) AS sizes, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4
            FROM documents
        ), placed AS (
            SELECT *, len(sizes) AS n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
                coalesce(list_sum(sizes[1:least(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1))]), 0) AS a, coalesce(list_sum(sizes[1:greatest(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1))]), 0) AS b
            FROM drawn
        ), out AS (
            SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, CAST(a AS BIGINT)) || '<S>' || substring(t, CAST(b AS BIGINT) + 1) || '<M>' || substring(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))
                ELSE '<S>' || substring(t, CAST(b AS BIGINT) + 1) || '<P>' || substring(t, 1, CAST(a AS BIGINT)) || '<M>' || substring(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) END AS o
            FROM placed
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
            sha256(o) AS output_sha256, sha256(t) AS restored_sha256
        FROM out
    """
