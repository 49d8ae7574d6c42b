"""The queries of the operators in this subpackage, and their SQL where it can express them.

Each query takes the whole table and keeps its operator's results for nulls, empty texts and tables, ties, repeated
rows and extra columns, which the operator's module states. In short: one row for each input row (op2: ten for each
query vector, op5: two for each page); null texts count as empty; empty tables give empty results; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies over two-word shingles; a null id has a null component and is kept."""
    from plumbline.llm import minhash

    return minhash.group(_read(spark, sf_dir, "documents"), k=2)


def pieces_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector whose id is divisible by 100; vectors that are null, zero or not finite take no part."""
    from plumbline.llm import ann

    return ann.search(_read(spark, sf_dir, "embeddings"))


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and verdict of every document; a text without n-grams has weight 0."""
    from plumbline.llm import resample

    return resample.weigh(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null page is empty, a null URL has an empty host."""
    from plumbline.llm import pages

    return pages.extract(_read(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a derived record, two a page: ids, links, lengths and digests."""
    from plumbline.llm import warc

    out = warc.build(warc.responses_of(_read(spark, sf_dir, "pages")))
    return out.select(
        "page_id", "kind", "record_id", "refers_to", "target_uri",
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["WARC-Payload-Digest"].alias("payload_digest"),
        F.length("block").cast("long").alias("content_length"),
        F.sha2("block", 256).alias("block_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document; a null source or language is a category."""
    from plumbline.llm import mixing

    return mixing.weigh(_read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text; a null text has none."""
    from plumbline.llm import pii

    return pii.find(_read(spark, sf_dir, "documents"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text; texts without words fail the rules."""
    from plumbline.llm import lines

    docs = _read(spark, sf_dir, "documents")
    return lines.judge(docs, lines.fit(docs, _read(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text; a null text has none."""
    from plumbline.llm import tokens

    return tokens.token_counts(_read(spark, sf_dir, "documents"), pieces_model())


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, a digest of the token ids, and whether they decode to the text."""
    from plumbline.llm import tokens

    return tokens.round_trip(_read(spark, sf_dir, "documents"), pieces_model())


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_ann": op2_ann,
    "op3_resample": op3_resample,
    "op4_pages": op4_pages,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_line_quality": op8_line_quality,
    "op9_token_counts": op9_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
}

SQL = {
    "op1_minhash": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
sh as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as s from w),
one as (select min(doc_id) as rep, s0 as s from (select doc_id, list_sort(s) as s0 from sh where len(s) > 0) group by s0),
el as (select rep, len(s) as n, unnest(s) as g from one),
freq as (select g, count(*) as c from el group by g),
ranked as (select el.rep, el.n, el.g, row_number() over (partition by el.rep order by c, el.g) as p from el join freq using (g)),
pref as (select * from ranked where p <= n - ceil(n * 80 / 100.0) + 1),
cand as (select distinct a.rep as x, b.rep as y from pref a join pref b on a.g = b.g and a.rep < b.rep
         where least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
ver as (select c.x, c.y, len(list_intersect(a.s, b.s)) as i, len(a.s) + len(b.s) as t
        from cand c join one a on a.rep = c.x join one b on b.rep = c.y),
e as (select x, y from ver where 100 * i >= 80 * (t - i)),
copies as (select sh.doc_id as x, one.rep as y from sh join one on list_sort(sh.s) = one.s where sh.doc_id <> one.rep),
ways as (select x, y from e union select y, x from e union select x, y from copies union select y, x from copies),
reach as (
  with recursive r(doc_id, node) as (select doc_id, doc_id from sh union select r.doc_id, b.y from r join ways b on r.node = b.x)
  select doc_id, min(node) as component_id from r group by doc_id)
select sh.doc_id, cast(len(sh.s) as bigint) as n_shingles, reach.component_id, sh.doc_id = reach.component_id as kept
from sh join reach using (doc_id)
"""
}
