"""The registered ``opN_<name>`` queries: each applies its operator to whole tables and derives the columns that the query returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, lexical, licences, mixing, near_dedup, neighbours, packing, quality, sharding, token_counts, token_files, url_filter, whitening

URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)
    return found.select("query_id", "rank", F.col("neighbour").alias("vec_id"), "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.assign(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(key: str = "doc_id"):
    """Rows that no fit may see."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def quality_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Chain:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    return quality.fit(docs, labels)


QUALITY_FROM = 0.7


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", quality.score(quality_chain(spark, docs, sf_dir), F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for files ``source/lang/doc_id``."""
    files = _table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")))
    return licences.scan(files)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents, then reads them back."""
    folder = token_files.new_folder(spark)
    token_files.write_ids(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder)
    return token_files.read_ids(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    found = lexical.search(index, _table(spark, sf_dir, "benchmark"), k=10)
    index.discard()
    return found


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), k=4)


def whitening_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op13_whitening`` that SQL can express."""
    return op13_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2_fingerprints`` that SQL can express."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op10_url_filter`` that SQL can express."""
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate({{x}}, '{_UPPER}', '{_UPPER.lower()}')"
SQL = {
    "op9_near_dedup": rf"""
        with recursive w as (select doc_id, list_filter(string_split_regex({_LOWERED.format(x="coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as sh from w),
        e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
        p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        l as (select x, y from p union all select y, x from p),
        r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
        m as (select x, min(y) as y from r group by x)
        select doc_id, len(sh)::bigint as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id, doc_id <= coalesce(y, doc_id) as kept from s left join m on x = doc_id""",
    "edited_texts": """
        with d as (select doc_id, coalesce(text, '') as t from documents),
        n as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nxt from d)
        select doc_id, length(t) as n_chars, sha256(left(t, length(t) - length(t) // 4) || left(nxt, length(t) // 4)) as edited_sha256 from n""",
    "url_parts": f"""
        with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        h as (select page_id, {_LOWERED.format(x="regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)
        select page_id, host, path, case
            when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
        from h""",
    "op12_lexical_search": rf"""
        with t as (select row_number() over () as d, doc_id, regexp_extract_all({_LOWERED.format(x="coalesce(text, '')")}, '{lexical.TERM}') as ts from documents),
        s as (select count(*)::bigint as docs, sum(len(ts))::bigint as total from t where len(ts) > 0),
        p as (select d, doc_id, n, term, count(*)::bigint as tf from (select d, doc_id, len(ts)::bigint as n, unnest(ts) as term from t) group by all),
        w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by term, docs),
        q as (select i, item_id, unnest(list_distinct(ts)) as term from (
            select row_number() over () as i, item_id, regexp_extract_all({_LOWERED.format(x="coalesce(text, '')")}, '{lexical.TERM}') as ts from benchmark)),
        c as (select i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::bigint as score
            from q join p using (term) join w using (term), s group by all),
        r as (select item_id, row_number() over (partition by i order by score desc, doc_id, d)::int as rank, doc_id, score from c where score > 0)
        select item_id, rank, doc_id, score from r where rank <= 10""",
    "whitening_distances": """
        with v as (select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as f from embeddings
            where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
        x as (select vec_id, list_transform(f, lambda c: c::bigint) as x from v),
        u as (select distinct x from x),
        n as (select len(x) as k, count(*)::bigint as n from u group by len(x)),
        e as (select len(x) as k, unnest(range(1, len(x) + 1)) as j, unnest(x) as c from u),
        s as (select k, list(total order by j) as sums from (select k, j, sum(c) as total from e group by k, j) group by k)
        select vec_id, component::int as component, n,
            list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i]::hugeint - sums[i]) * (n * x[i]::hugeint - sums[i])))::bigint as deviation
        from x join n on len(x) = n.k join s on s.k = n.k, range(1, 5) as c(component) where component <= len(x)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbours, op2_fingerprints, op3_token_counts, op4_mixing, op5_sharding, op6_quality, op7_licences, op8_packing, op9_near_dedup, op10_url_filter, op11_token_files, op12_lexical_search, op13_whitening, edited_texts, url_parts, whitening_distances)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
