"""The named queries of these operators and the SQL counterparts of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayside.llm import quality, toxicity
from wayside.llm.align import alignment
from wayside.llm.bpe import digests
from wayside.llm.common import documents
from wayside.llm.decontaminate import contaminated
from wayside.llm.exact import exact_groups
from wayside.llm.fingerprint import compared_with_edits
from wayside.llm.mixing import mix
from wayside.llm.phrases import collocations
from wayside.llm.simhash import near_groups
from wayside.llm.suffix_lm import score_texts
from wayside.llm.token_files import read_tokens, write_tokens
from wayside.llm.urls import judge_urls

VOCABULARY = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    return compared_with_edits(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the group it links to."""
    return near_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).drop("url")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, labels))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, quality.train(docs, labels))


def op8_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under the suffix tree and under word counts."""
    return score_texts(documents(spark, sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to files and read back."""
    return read_tokens(write_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned over the bytes of every text."""
    return alignment(documents(spark, sf_dir), *map(public_tokenizers.path, ALIGNED))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in benchmark items, and in which."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_suffix_lm": op8_suffix_lm,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_files": op10_token_files,
    "op11_align": op11_align,
    "op12_decontaminate": op12_decontaminate,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        with n as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
        ), k as (
            select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, sha256(body) as text_sha256
            from n window g as (partition by body)
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k
    """,
    "op4_url_filter": r"""
        with u as (
            select page_id,
                translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
            from pages
        ), r as (
            select *, case
                when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
                when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
                when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
                when ('.' || host) like '%.net' and path like '/%' then 'net/'
            end as rule from u
        )
        select page_id, host, path, rule,
            case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
        from r
    """,
    "op9_mix_sources": r"""
        with sized as (
            select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
            from documents
        ), s as (
            select source, cast(sum(size) as bigint) as source_size from sized group by source
        ), w as (
            select source, source_size, 2.0::double * source_size as full_size,
                [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s
        ), f as (
            select *, row_number() over (order by full_size / weight, source nulls last) as turn,
                1.5::double * sum(source_size) over ()
                    - coalesce(sum(full_size) over (order by full_size / weight, source nulls last
                        rows between unbounded preceding and 1 preceding), 0) as rest,
                sum(weight) over () - coalesce(sum(weight) over (order by full_size / weight, source nulls last
                        rows between unbounded preceding and 1 preceding), 0) as unfilled
            from w
        ), l as (
            select *, rest / unfilled as level, full_size <= rest / unfilled * weight as capped from f
        ), t as (
            select source, source_size,
                case when capped then full_size
                     else weight * (select level from l where not capped order by turn limit 1) end as target from l
        ), copies as (
            select doc_id, source, size, pass, md5(doc_id || ':' || pass) as k from sized, (values (0), (1)) as p(pass)
        ), q as (
            select c.doc_id, c.size, t.source_size, t.target, c.k,
                sum(c.size) over (partition by c.source order by c.pass, c.k, c.doc_id rows unbounded preceding)
                    / nullif(t.target, 0) as finish
            from copies c join t on c.source is not distinct from t.source
        ), m as (
            select *, sum(size) over (order by finish nulls last, k, doc_id rows unbounded preceding) as through,
                1.5::double / 2 * sum(size) over () as budget from q
        )
        select doc_id, size, source_size, target,
            cast(sum(case when through <= budget and finish is not null then size else 0 end) as bigint) as taken
        from m group by all
    """,
    "op12_decontaminate": r"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
        ), b as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
        ), bw as (
            select distinct item_id, m, array_to_string(ws[i : i + m - 1], ' ') as w
            from (select item_id, ws, least(len(ws), 10) as m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from b where len(ws) > 0)
        ), dw as (
            select doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') as w
            from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from d, (select distinct m from bw))
        ), f as (
            select dw.doc_id, dw.i, dw.m, bw.item_id from dw join bw using (m, w)
        ), h as (
            select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from f) group by doc_id
        ), t as (
            select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as listed
            from (select distinct doc_id, item_id from f) group by doc_id
        )
        select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
            sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
    """,
    "op13_phrases": r"""
        with p as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ), w as (
            select lang, row_number() over () as piece, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p
        ), o as (
            select lang, piece, unnest(ws) as w, generate_subscripts(ws, 1) as pos from w
        ), q as (
            select lang, w, lead(w, 1) over g as w2, lead(w, 2) over g as w3 from o window g as (partition by piece order by pos)
        ), f as (
            select lang, 1 as k, w as phrase, count(*) as a from q group by all
            union all select lang, 2, w || ' ' || w2, count(*) from q where w2 is not null group by all
            union all select lang, 3, w || ' ' || w2 || ' ' || w3, count(*) from q where w3 is not null group by all
        ), n as (
            select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang
        ), c as (
            select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= 10
        ), cut as (
            select c.lang, c.k, c.phrase, c.ws, c.a, j, x.a as l, y.a as r,
                cast(1000000 * c.a::hugeint * c.a::hugeint // (x.a::hugeint * y.a::hugeint) as bigint) as score
            from (select *, unnest(range(1, k)) as j from c) as c
            join f as x on x.lang = c.lang and x.k = j and x.phrase = array_to_string(c.ws[1 : j], ' ')
            join f as y on y.lang = c.lang and y.k = c.k - j and y.phrase = array_to_string(c.ws[j + 1 : c.k], ' ')
        ), best as (
            select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1
        ), held as (
            select distinct lang, array_to_string(ws[i : i + 1], ' ') as phrase, a from (select *, unnest([1, 2]) as i from c where k = 3)
        ), kept as (
            select * from best b where not exists (
                select 1 from held h where h.lang = b.lang and h.phrase = b.phrase and 100 * h.a >= 50 * b.a)
        )
        select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n.n, score
        from kept join n on n.lang = kept.lang
        qualify rank <= 2000
    """,
}
