"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import decontamination, licences, line_dedup, mixing, near_dedup, pii, quality, secrets, sharding, tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_docs(spark, sf_dir))


def op4_token_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokens.read_tokens(tokens.write_tokens(_docs(spark, sf_dir), tokenizer, end=2))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_docs(spark, sf_dir))


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_docs(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two loads, the second against the filters of the first, then a deletion and its reversal
    return line_dedup.dedup_lines(_docs(spark, sf_dir), batches=2, withdrawn=32)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_licence_scan": op3_licence_scan,
    "op4_token_packing": op4_token_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_pii_bootstrap": op7_pii_bootstrap,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
        with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select r, unnest(range(1, len(w) - 3)) as pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from d where len(w) >= 5),
        twice as (select r, pos from win qualify count(*) over (partition by r, g) > 1),
        rep as (select r, count(distinct pos + k) as n_repeat_words from twice, range(0, 5) x(k) group by r),
        lines as (select r, unnest(string_split(text, chr(10))) as line from d),
        dup as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
        f as (select r, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
                     coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
                     coalesce(list_sum(list_transform(range(1, len(w)), lambda i: (w[i] = w[i + 1])::int)), 0)::bigint as n_stutter,
                     length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals, length(regexp_replace(text, '[^!?~^_=+{}\[\]\\/@`]', '', 'g'))::bigint as n_marks
              from d left join rep using (r) left join dup using (r)),
        m as (select *, n_symbols * 1000 // greatest(n_words, 1) as symbols, n_dup_lines * 1000 // greatest(n_lines, 1) as duplicate_lines, n_repeat_words * 1000 // greatest(n_words, 1) as repeats,
                     n_stutter * 1000 // greatest(n_words, 1) as stutter, n_capitals * 1000 // greatest(word_chars, 1) as capitals, n_marks * 1000 // greatest(n_words, 1) as marks, word_chars * 1000 // greatest(n_words, 1) as wide from f),
        long as (unpivot (select coalesce('=' || lang, 'null') as lang, coalesce('=' || source, 'null') as source, symbols, duplicate_lines, repeats, stutter, capitals, marks, wide, n_words, n_lines, word_chars from m where n_words > 0)
                 on symbols, duplicate_lines, repeats, stutter, capitals, marks, wide, n_words, n_lines, word_chars into name ratio value v),
        e as (select lang, source, ratio, v, greatest(length(bin(v)) - 9, 0) as e from long),
        sk as (select lang, source, ratio, (((v >> e) + 1) << e) - 1 as top, count(*) as n from e group by all),
        ks as (select unnest(range(0, 20)) as k),
        run0 as (select ratio, top, sum(n) over (partition by ratio order by top) as cum, sum(n) over (partition by ratio) as total from (select ratio, top, sum(n) as n from sk group by all)),
        pri0 as (select ratio, k, min(top) filter (cum * 40 >= total * (2 * k + 1)) as top from run0, ks group by all),
        rows1 as (select lang, ratio, top, n from sk union all select lang, ratio, top, 1 from (select distinct lang, ratio from sk) join pri0 using (ratio)),
        run1 as (select lang, ratio, top, sum(n) over (partition by lang, ratio order by top) as cum, sum(n) over (partition by lang, ratio) as total from (select lang, ratio, top, sum(n) as n from rows1 group by all)),
        pri1 as (select lang, ratio, k, min(top) filter (cum * 40 >= total * (2 * k + 1)) as top from run1, ks group by all),
        rows2 as (select lang, source, ratio, top, n from sk union all select lang, source, ratio, top, 1 from (select distinct lang, source, ratio from sk) join pri1 using (lang, ratio)),
        run2 as (select lang, source, ratio, top, sum(n) over (partition by lang, source, ratio order by top) as cum, sum(n) over (partition by lang, source, ratio) as total from (select lang, source, ratio, top, sum(n) as n from rows2 group by all)),
        q as (select lang, source, ratio, min(top) filter (cum * 100 >= total * 25) as q25, min(top) filter (cum * 100 >= total * 50) as q50, min(top) filter (cum * 100 >= total * 75) as q75, min(top) filter (cum * 100 >= total * 90) as q90,
                     min(top) filter (cum * 100 >= total * 95) as q95, min(top) filter (cum * 100 >= total * 98) as q98, min(top) filter (cum * 100 >= total * 99) as q99 from run2 group by all),
        ev as (select * from (values ('symbols', 'n_words', 1000), ('duplicate_lines', 'n_lines', 1000), ('repeats', 'n_words', 10000), ('stutter', 'n_words', 1000), ('capitals', 'word_chars', 5000), ('marks', 'n_words', 1000), ('wide', 'n_words', 5000)) x(ratio, share, n)),
        u as (select q.*, greatest(1, ev.n // greatest(m.q50, 1)) as u from q join ev using (ratio) join q m on m.lang = q.lang and m.source = q.source and m.ratio = ev.share),
        s0 as (select *, q50 - q25 as s, true as ok from u),
        s1 as (select * replace (case when ok and q75 - q50 <= 4 * (s + u) then greatest(s, q75 - q50) else s end as s, ok and q75 - q50 <= 4 * (s + u) as ok) from s0),
        s2 as (select * replace (case when ok and q90 - q50 <= 4 * (s + u) then greatest(s, q90 - q50) else s end as s, ok and q90 - q50 <= 4 * (s + u) as ok) from s1),
        s3 as (select * replace (case when ok and q95 - q50 <= 4 * (s + u) then greatest(s, q95 - q50) else s end as s, ok and q95 - q50 <= 4 * (s + u) as ok) from s2),
        s4 as (select * replace (case when ok and q98 - q50 <= 4 * (s + u) then greatest(s, q98 - q50) else s end as s, ok and q98 - q50 <= 4 * (s + u) as ok) from s3),
        s5 as (select * replace (case when ok and q99 - q50 <= 4 * (s + u) then greatest(s, q99 - q50) else s end as s, ok and q99 - q50 <= 4 * (s + u) as ok) from s4),
        lim as (select lang, source, ratio, (q50 + 4 * (s + u))::bigint as lim from s5),
        wide_lim as (select lang as gl, source as gs, max(lim) filter (ratio = 'symbols') as max_symbols, max(lim) filter (ratio = 'duplicate_lines') as max_duplicate_lines, max(lim) filter (ratio = 'repeats') as max_repeats, max(lim) filter (ratio = 'stutter') as max_stutter,
                            max(lim) filter (ratio = 'capitals') as max_capitals, max(lim) filter (ratio = 'marks') as max_marks, max(lim) filter (ratio = 'wide') as max_wide from lim group by lang, source)
        select doc_id, m.lang, m.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
               not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(symbols > max_symbols or duplicate_lines > max_duplicate_lines or repeats > max_repeats or stutter > max_stutter or capitals > max_capitals or marks > max_marks or wide > max_wide, false) as kept,
               max_symbols, max_duplicate_lines, max_repeats, max_stutter, max_capitals, max_marks, max_wide
        from m left join wide_lim w on w.gl = coalesce('=' || m.lang, 'null') and w.gs = coalesce('=' || m.source, 'null')
    """,
    "op5_minhash_near_dedup": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, unnest(case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as g from w),
        n as (select w.doc_id, count(g) as n from w left join s on s.doc_id = w.doc_id group by 1),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
        ends as (select a, b from e union all select b, a from e),
        reach as (select doc_id as id, doc_id as other from w union select r.id, e.b from reach r join ends e on e.a = r.other),
        c as (select id as doc_id, min(other) as component_id from reach group by id)
        select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join c using (doc_id)
    """,
    "op8_line_dedup": """
        with raw as (select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                            unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos from documents),
        keyed as (select doc_id, pos, line,
                         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from raw),
        refs as (select k, count(distinct doc_id) as n, max(doc_id) as last from keyed where length(k) >= 20 group by k),
        marked as (select keyed.*, coalesce(n >= 3 and doc_id <> last, false) as lost from keyed left join refs using (k))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
        from marked group by doc_id
    """,
}
