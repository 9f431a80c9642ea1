"""The queries of this subpackage: name to function of (spark, sf_dir), and SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, exact, hmm, jaccard, lengths, phrases, pieces, quality, suffixes, tiling, toxicity, urls, warc


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents"), threshold=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(_read(spark, sf_dir, "pages")), records=False).withColumnRenamed("source_id", "page_id")
    return made.withColumn("source_headers", F.to_json(F.map_from_entries("source_headers")))  # the fixed header repeats no field


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(_read(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.encode(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lengths.token_lengths(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))
    return lengths.suffix_sums(lengths.histogram(made))


def op11_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_read(spark, sf_dir, "documents"))


def op12_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.match_clicks(_read(spark, sf_dir, "clicks"), _read(spark, sf_dir, "sales"), hours=72)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), least=100, top=2_000)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_repeats, op3_urls, op4_quality, op5_warc, op6_exact, op7_pieces, op8_tiling, op9_jaccard, op10_lengths, op11_hmm, op12_asof, op13_phrases)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BAD = " or ".join(f"contains('.' || host, '.{x}')" for x in urls.DEFAULT_BLOCKED)
_DAY = 86_400_000_000


def _crc32(x: str) -> str:
    """The checksum bit by bit: -1 stands for a shift."""
    steps = f"[4294967295] || flatten(list_transform(string_split(cast({x} as varchar), ''), lambda d: [cast(ascii(d) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"4294967295 - list_reduce({steps}, lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end)"


ORACLES = {
    "op3_urls": f"""
        with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
        ruled as (select *, case when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                                 when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                                 when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'org/fr/'
                                 when ends_with('.' || host, '.net') and starts_with(path, '/') then 'net/' end as rule from parts)
        select page_id, host, path, rule, case when rule in ('example.com/de/', 'net/') then 'block' when rule is not null then 'allow'
               when {_BAD} then 'block' else 'allow' end as verdict from ruled""",
    "op6_exact": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
               sha256(coalesce(text, '')) as text_sha256, cast(strlen(coalesce(text, '')) as bigint) as n_bytes
        from documents window same as (partition by coalesce(text, ''))""",
    "op12_asof": f"""
        with points as (select click_id, min(client_id) as client_id, epoch_us(min(ts)) as t, {_crc32("click_id")} as h from clicks group by click_id),
        asked as (select click_id, client_id, case when h % 2 = 1 then t - t % {_DAY} else t end as ts_us from points),
        one as (select client_id, sale_id, priority, cast(floor(100 * total + 0.5) as bigint) as total_cents, epoch_us(sold_at) as t, {_crc32("sale_id")} as h from sales
                where client_id is not null and sold_at is not null),
        own as (select *, case when h % 2 = 1 then t - t % {_DAY} else t end as moment from one),
        orders as (select client_id, moment, priority, sale_id, total_cents from own union all select client_id, moment, 6 - priority, -1 - sale_id, total_cents from own where h % 3 <> 0),
        runs as (select *, count(*) over (partition by client_id, moment) as n_tied, row_number() over (partition by client_id, moment order by priority desc nulls last, sale_id nulls last) as place from orders),
        met as (select a.*, r.sale_id, r.moment, r.total_cents, r.n_tied from asked a asof left join (select * from runs where place = 1) r on a.client_id = r.client_id and a.ts_us >= r.moment)
        select click_id, client_id, ts_us, case when ok then sale_id end as sale_id, case when ok then ts_us - moment end as lag_us, case when ok then total_cents end as total_cents,
               case when ok then n_tied else 0 end as n_tied from (select *, coalesce(ts_us - moment <= {72 * 3_600_000_000}, false) as ok from met)""",
    "op13_phrases": f"""
        with pieces as (select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\n\\x0B\\x0C\\r]')) as piece from documents),
        spoken as (select row_number() over () as p, lang, regexp_extract_all(piece, '[^ \\t]+') as w from pieces),
        total as (select lang, sum(len(w)) as n from spoken group by lang),
        starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from spoken),
        grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from starts, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w)),
        f as (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase having count(*) >= 100),
        cuts as (select f.lang, f.k, f.phrase, f.a, unnest(range(1, f.k)) as j, string_split(f.phrase, ' ') as w from f where f.k > 1),
        scored as (select c.lang, c.k, c.phrase, c.a, c.j, x.a as l, y.a as r, t.n, (1000::hugeint * c.a::hugeint * t.n::hugeint) // (x.a::hugeint * y.a::hugeint) as score
                   from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.j + 1 :], ' ') join total t on t.lang = c.lang),
        worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        inside as (select f.lang, f.a, unnest([array_to_string(string_split(f.phrase, ' ')[1 : f.k - 1], ' '), array_to_string(string_split(f.phrase, ' ')[2 :], ' ')]) as phrase from f where f.k > 2),
        best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst w
                 where not exists (select 1 from inside i where i.lang = w.lang and i.phrase = w.phrase and i.a = w.a))
        select lang, cast(rank as bigint) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from best where rank <= 2000""",
}
