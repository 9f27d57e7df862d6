"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.llm.common import TASK_BYTES, gathered, table, text_bytes

#: Rows of a few numbers that a result's file holds at least.
NARROW = 20_000


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verba.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verba.llm.html_diff import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of line runs of 50 words or more."""
    from verba.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gathered(dedup_lines(docs, min_words=50), text_bytes(docs), TASK_BYTES)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verba.llm.url_gbt import judge

    return judge(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and the text that they decode to."""
    from verba.llm.sentencepiece_fst import encode_documents

    docs = table(spark, sf_dir, "documents")
    return gathered(encode_documents(docs, tokenizer("piece_bpe_32k.model"), decoded=True), docs.count())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verba.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents")
    return gathered(token_counts(docs, tokenizer("piece_bpe_32k.model")), docs.count(), NARROW)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 100; candidates: every other row."""
    from verba.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"), k=10, scale=1024)


def held_out(id_col: str = "doc_id"):
    """Whether a document's labels are held out of training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learnt from documents that are not held out only."""
    from verba.llm import quality_fm

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_fm.train(labelled(docs, labels))
    out = gathered(quality_fm.score(docs.select("doc_id", "text"), model, ["doc_id"]), docs.count(), NARROW)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y, doc_id) of the labelled documents that are not held out, one label per id."""
    from verba.llm.common import small

    y = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    side, _ = small(y)
    return docs.select("doc_id", "text").join(side, "doc_id").select("text", "y", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files, reads them into an archive, rebuilds the records and tells what they say."""
    from verba.llm import warc
    from verba.llm.common import Scratch

    scratch = Scratch(spark, "warc")
    warc.write_files(table(spark, sf_dir, "pages"), f"{scratch.root}/files", least=100)
    warc.ingest(spark, f"{scratch.root}/files", f"{scratch.root}/archive")
    scratch.drop("files")
    return warc.described(warc.rebuilt(spark, f"{scratch.root}/archive"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document leaks, with the best window."""
    from verba.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    found = (op1_ngram_jaccard_join, op2_html_extraction, op3_line_dedup, op4_url_filters, op5_sentencepiece, op6_token_counts, op7_exact_top_k, op8_quality_classifier, op9_warc, op10_decontamination)
    return {f.__name__: f for f in found}


#: What DuckDB can express.  The others have tests against brute force.
ORACLE = {
    "op1_ngram_jaccard_join": """
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') l from documents),
        s as (select doc_id, case when len(l) = 0 then cast([] as varchar[]) when len(l) < 4 then [array_to_string(l, ' ')]
                             else list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) end s from w),
        e as (select doc_id, unnest(s) g from s),
        p as (select a.doc_id a, b.doc_id b, count(*) o from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        k as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * o >= 85 * (len(x.s) + len(y.s) - o)),
        u as (select a, b from k union all select b, a from k),
        r as (select doc_id id, doc_id c from s union select u.a, r.c from r join u on u.b = r.id)
        select doc_id, cast(any_value(len(s)) as bigint) n_shingles, min(c) component_id from s join r on r.id = doc_id group by doc_id""",
    "op7_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
                   where vec_id is not null and embedding is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) score
              from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op9_warc": """
        with p as (select page_id, encode(coalesce(html, '')) b from pages),
        d as (select page_id, octet_length(b) n, sha256(b) h from p),
        f as (select *, min(page_id) over (partition by h) lo from d)
        select page_id, cast(n as bigint) payload_bytes, h payload_digest,
               case when n >= 100 and page_id > lo then 'revisit' else 'response' end record_type,
               case when n >= 100 and page_id > lo then lo end refers_to from f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
