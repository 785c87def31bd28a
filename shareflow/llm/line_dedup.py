r"""Line deduplication: lines that many documents hold go, but for one document that keeps them.

Texts are split at \n. A line's key is the line without the ASCII white space at its ends, A-Z in lower case. Keys of at
least LEAST_CHARS code points are hashed to 128 bits and exploded with their positions; the distinct documents of each
hash are counted; hashes of at least LEAST_DOCUMENTS documents join the exploded rows again, and positions of all but the
greatest doc_id that holds the key are dropped. Texts are put together from the positions that stay. Only hashes and
positions meet in the shuffles by hash; texts are moved once, for their dropped positions.

Hot lines: documents are counted by (hash, document) first, so no task counts all rows of one hash, and hashes and texts
with many rows are broadcast when they join (common.join_groups). Results:

- null or empty text is one empty line and keeps it; lines shorter than LEAST_CHARS always stay, in their place;
- a line that stays is returned as it is, with its white space and capitals; a document that loses all lines has empty text;
- rows with one doc_id are one document: they count once for a key, and each of them keeps or loses its lines alike;
- all rows without a doc_id are one document, smaller than every other, so they never keep a repeated line;
- a row per row of the input, repeated rows too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shareflow.llm.common import join_groups, text_or_empty, written

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: ASCII white space.
_ENDS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_ENDS))


def _row_key() -> Column:
    """128 bits of doc_id and text: rows that agree in both have the same lines and the same answer."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_or_empty())))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, row_key, line_no and line_hash of every line whose key has at least least_chars code points."""
    keyed = F.transform(lines(text_or_empty()), lambda x, i: F.struct(i.alias("line_no"), trimmed(x).alias("key")))
    long = F.filter(keyed, lambda x: F.char_length(x["key"]) >= least_chars)
    lower = lambda k: F.translate(k, string.ascii_uppercase, string.ascii_lowercase)
    hashed = F.transform(long, lambda x: F.struct(x["line_no"].alias("line_no"), F.unhex(F.md5(lower(x["key"]))).alias("line_hash")))
    return docs.select("doc_id", _row_key().alias("row_key"), F.explode(hashed).alias("line")).select("doc_id", "row_key", "line.line_no", "line.line_hash")


def repeated_lines(found: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """line_hash, n_documents, keep_id (the greatest doc_id) and n_rows of the hashes that enough documents hold."""
    once = found.groupBy("line_hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = once.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_documents"), F.max("doc_id").alias("keep_id"), F.sum("n").alias("n_rows"))
    return counted.filter(F.col("n_documents") >= least_documents)


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row of docs."""
    found = written(line_hashes(docs, least_chars), "line-hashes")
    matched = join_groups(found, repeated_lines(found, least_documents), ["line_hash"])
    lost = matched.filter(F.col("n_documents").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # repeated rows give each position as often as they occur
    places = lost.groupBy("row_key", "line_no").agg(F.count(F.lit(1)).alias("n"))
    dropped = places.groupBy("row_key").agg(F.collect_list("line_no").alias("dropped"), F.max("n").alias("n_rows"))
    texts = docs.select("doc_id", text_or_empty().alias("text"), _row_key().alias("row_key"))
    both = join_groups(texts, dropped, ["row_key"])
    n = F.size(lines(F.col("text"))).cast("long")
    # the lines are a variable of a lambda, so that the text is split once and not for each position
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: F.get(x, i))
    rebuilt = F.array_join(F.flatten(F.transform(F.array(lines(F.col("text"))), stay)), "\n")
    return both.select(
        "doc_id",
        n.alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rebuilt).alias("kept_text"),
    )


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as row_no from documents),
n as (select doc_id, row_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from d),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from n),
r as (select key, max(doc_id) as keep_id from k where length(key) >= 40 group by key having count(distinct coalesce(cast(doc_id as varchar), 'null')) >= 5),
m as (select k.*, r.key is not null and k.doc_id is distinct from r.keep_id as dropped from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not dropped), '')) as kept_sha256
from m group by doc_id, row_no
"""
