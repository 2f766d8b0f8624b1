"""Every operator as a query over the given tables, with the same result as plain SQL.

The tables hold no search keywords, so documents, parts, orders, line items and
conversations stand in for them (README, "Queries"). Rule operators run with the real rule
tables and with a pack in the tables' own vocabulary, so that every tier and bucket is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import fixed_values as fixed
from termloom.functions.calendar import in_cyclone_season
from termloom.functions.numbers import mean_of_parts, mean_parts, round_exact
from termloom.functions.rules import RuleTable
from termloom.operators import diagnostics, intent, keyed, language, numbering, summaries, themes
from termloom.operators.frontier import query_frontier
from termloom.operators.interest import monthly_average, unpivot_interest
from termloom.operators.noise import route_noise
from termloom.operators.rulebook import rule_hits
from termloom.operators.seasons import monthly_matrix, season_average, season_summary
from termloom.plans.curate import curate
from termloom.session import shared_folder
from termloom.sources.interest import read_interest, read_interest_lines
from termloom.session import stored as stored_once
from termloom.sinks import reports
from termloom.sinks.months import merge_scores, read_months
from termloom.sinks.tables import append_keywords, append_scores
from termloom.sources.sheets import read_sheet
from termloom.sources.suggestions import decode_suggestions
from termloom.sources.tables import first_keywords, read_keywords, read_scores
from termloom.streaming.append import append_recent, append_spellings, append_stream, end_round, stream_payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# --- rule packs in the vocabulary of the tables ------------------------------

NOISE_PACK = {
    "competitor": ["ouantion", "thtion", "stouwh", "anre"],
    "off_topic": [
        r"\bque la\b", r"\bnich", r"ó?n para\b", r"\bth(or|ing)s?\b", r"what (is|are) .+ the\b",
        r"token .+ de\b", r"\bthe\.$",
    ],
}
INTENT_PACK = {
    fixed.INTENT_NAVIGATIONAL: [r"token =", r"\bthwhs", r"\.{2}", r"\bque el"],
    fixed.INTENT_TRANSACTIONAL: [r"\bpour la\b", r"\bf[uü]r\b", r"r[ée]treau", r"\bonneds?\b"],
    fixed.INTENT_INFORMATIONAL: [r"\bwas\b", r"\bthtion", r"\b(mit|von) der\b", r"\bno (la )?los\b"],
}
COMMERCIAL_PACK = {fixed.INTENT_COMMERCIAL: [r"\bthe\b", r"\bdes?\b", r"\bund\b", r"éau"]}

NOISE_RULES = RuleTable.of(NOISE_PACK)
INTENT_RULES = RuleTable.of(INTENT_PACK)
COMMERCIAL_RULES = RuleTable.of(COMMERCIAL_PACK)
FOUR_TIERS = RuleTable.of(INTENT_PACK | COMMERCIAL_PACK)
CONFLICT_RULES = RuleTable.of(dict(zip(fixed.CATEGORY_NAMES, (INTENT_PACK | COMMERCIAL_PACK).values())))
THEME_PACK = [
    ("red p", "warm_plates"), ("red", "warm"), ("hot", "warm"), ("blue", "cool"),
    ("cold g", "cool_gear"), ("old", "used"), ("new", "fresh"),
]

# --- SQL pieces ----------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _match(pattern: str, column: str = "low") -> str:
    """The rule as a regular expression of the oracle, whose own word boundary is ASCII only."""
    body = pattern
    if body.startswith(r"\b"):
        body = r"(?:^|[^\p{L}\p{N}_])" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    if body.endswith("$"):
        body = body[:-1] + r"\n?$"
    return f"regexp_matches({column}, {_text(body)})"


def _any(patterns: list[str]) -> str:
    return "(" + " or ".join(_match(p) for p in patterns) + ")"


def _case(groups: dict[str, list[str]], what: str) -> str:
    """First matching rule as CASE; ``what`` picks the category or the rule's text."""
    arms = []
    for name, patterns in groups.items():
        for pattern in patterns:
            label = name
            if what == "rule":
                label = ("commercial:" if name == fixed.INTENT_COMMERCIAL else "") + pattern
            arms.append(f"when {_match(pattern)} then {_text(label)}")
    return "case " + " ".join(arms) + " end"


def _language_sql() -> str:
    counts = {
        code: " + ".join(f"cast({_match(p)} as int)" for p in patterns)
        for code, patterns in fixed.LANGUAGE_MARKERS.items()
    }
    scores = ", ".join(f"{sql} as n_{code}" for code, sql in counts.items())
    names = list(counts)
    arms = " ".join(
        f"when {' and '.join(f'n_{c} > n_{o}' for o in names if o != c)} then '{c}'" for c in names
    )
    return f"""det as (select *, case {arms} end as detected_lang from (select *, {scores} from docs))"""


DOCS = """with docs as (
  select doc_id as id, text as keyword, lang, source, lower(text) as low from documents)"""

TAGS = """with docs as (
  select d.doc_id as id, d.text as keyword, d.lang, d.source, lower(d.text) as low,
    case when l.toxic = 1 then 'exclure' when l.quality = 1 then 'transactionnel' else '' end as tag
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def _mean(column: str, where: str = "") -> str:
    kept = f" filter ({where})" if where else ""
    total = f"cast(sum(cast({column} as decimal(18,2))){kept} as double) / count({column}){kept}"
    return f"cast(printf('%.2f', {total}) as double)"


# --- inputs ----------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored keywords; the source also stands in for the seed."""
    return _read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("keyword"), "lang", "source",
        F.col("source").alias("seed"), F.col("doc_id").alias("ord"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for rule queries, read as the table comes."""
    return keywords(spark, sf_dir)


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tagging sheet, tagged from their labels."""
    labels = _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    tag = (
        F.when(F.col("toxic") == 1, " Exclure").when(F.col("quality") == 1, "TRANSACTIONNEL ")
        .otherwise("")
    )
    notes = (
        F.when(F.col("source") == "src0", "EN").when(F.col("source") == "src1", " it ")
        .when(F.col("source") == "src2", "free text").otherwise("")
    )
    return (
        texts(spark, sf_dir).join(labels, "id", "left")
        .withColumns({"intent": tag, "notes": notes})
        .select("id", "keyword", "seed", "source", "lang", "intent", "notes", "ord")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as month scores: priority = keyword, total price = score."""
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("keyword"), F.month("o_orderdate").alias("month"),
        F.col("o_totalprice").alias("interest_score"), F.col("o_orderkey").alias("ord"),
        F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("date"),
    )


# --- seasonality -------------------------------------------------------------------


@query("season_summary", f"""
select o_orderpriority as keyword,
  coalesce({_mean('o_totalprice', 'month(o_orderdate) > 3')}, 0.0) as haute_saison,
  coalesce({_mean('o_totalprice', 'month(o_orderdate) <= 3')}, 0.0) as saison_cyclonique
from orders group by 1""")
def _(spark, sf_dir):
    return season_summary(scores(spark, sf_dir))


@query("season_average", f"""
select o_orderpriority as keyword,
  case when month(o_orderdate) <= 3 then 'saison_cyclonique' else 'haute_saison' end as season,
  {_mean('o_totalprice')} as score
from orders group by 1, 2""")
def _(spark, sf_dir):
    return season_average(scores(spark, sf_dir))


@query("monthly_average", f"""
select o_orderpriority as keyword, cast(month(o_orderdate) as int) as month,
  {_mean('o_totalprice')} as interest_score
from orders group by 1, 2""")
def _(spark, sf_dir):
    return monthly_average(scores(spark, sf_dir), ["keyword"], value="interest_score")


@query("monthly_average_last_batch", f"""
select o_orderpriority as keyword, cast(month(o_orderdate) as int) as month,
  {_mean('o_totalprice')} as interest_score
from orders join (select o_orderpriority as p, max(year(o_orderdate)) as y from orders group by 1)
  on p = o_orderpriority and y = year(o_orderdate)
group by 1, 2""")
def _(spark, sf_dir):
    by_year = scores(spark, sf_dir).withColumn("year", F.year("date"))
    return monthly_average(by_year, ["keyword"], value="interest_score", batch="year")


@query("monthly_matrix", "select o_orderpriority as keyword, " + ", ".join(
    f"coalesce(arg_max(o_totalprice, o_orderkey) filter (month(o_orderdate) = {n}), 0.0) as \"{label}\""
    for n, label in enumerate(fixed.MONTH_LABELS, start=1)
) + " from orders group by 1")
def _(spark, sf_dir):
    return monthly_matrix(scores(spark, sf_dir))


@query("seasonality_by_geo", f"""
select n_name as geo, o_orderpriority as keyword,
  coalesce({_mean('o_totalprice', 'month(o_orderdate) > 3')}, 0.0) as haute_saison,
  coalesce({_mean('o_totalprice', 'month(o_orderdate) <= 3')}, 0.0) as saison_cyclonique
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by 1, 2""")
def _(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer").join(
        _read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("custkey"), F.col("n_name").alias("geo"))
    # a customer's orders are cut down by month only, so they are joined as they come (a skewed
    # customer is split) and reduced to a few rows per task behind the join
    parts = scores(spark, sf_dir).join(customers, "custkey").groupBy(
        "geo", "keyword", in_cyclone_season(F.col("month")).alias("cyclone")
    ).agg(*mean_parts(F.col("interest_score")))
    cyclone = F.col("cyclone")
    return parts.groupBy("geo", "keyword").agg(
        F.coalesce(round_exact(mean_of_parts(where=~cyclone)), F.lit(0.0)).alias(fixed.HIGH_SEASON),
        F.coalesce(round_exact(mean_of_parts(where=cyclone)), F.lit(0.0)).alias(fixed.CYCLONE_SEASON),
    )


def _lineitem_wide(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_linestatus") == "O").alias("isPartial"), F.col("l_returnflag").alias("flag"),
    )


def _lineitem_series(spark, sf_dir) -> DataFrame:
    return unpivot_interest(_lineitem_wide(spark, sf_dir).drop("flag"))


LINEITEM_SERIES = """(
  select l_shipdate as date, 'quantity' as keyword, l_quantity as value from lineitem
  union all select l_shipdate, 'discount', l_discount from lineitem
  union all select l_shipdate, 'tax', l_tax from lineitem)"""


@query("interest_unpivot", f"select date, keyword, value from {LINEITEM_SERIES}")
def _(spark, sf_dir):
    return _lineitem_series(spark, sf_dir)


@query("interest_monthly", f"""
select keyword, cast(month(date) as int) as month, {_mean('value')} as interest_score
from {LINEITEM_SERIES} group by 1, 2""")
def _(spark, sf_dir):
    return monthly_average(_lineitem_series(spark, sf_dir), ["keyword"])


@query("interest_batches", f"""
select keyword, cast(month(date) as int) as month, {_mean('value')} as interest_score from (
  select l_shipdate as date, 'quantity' as keyword, l_quantity as value from lineitem
  union all select l_shipdate, 'discount', l_discount from lineitem where l_returnflag = 'N'
  union all select l_shipdate, 'tax', l_tax from lineitem where l_returnflag = 'N')
group by 1, 2""")
def _(spark, sf_dir):
    landed = shared_folder(spark, "interest")
    rows = _read(spark, sf_dir, "lineitem").withColumn("isPartial", F.lit(False))
    date, partial = F.col("l_shipdate").alias("date"), "isPartial"
    quantity, discount, tax = (F.col(f"l_{name}").alias(name) for name in ("quantity", "discount", "tax"))
    rows.select(date, quantity, discount, partial).write.parquet(f"{landed}/batch=0")
    later = rows.where(F.col("l_returnflag") == "N")
    later.select(date, discount, tax, partial).write.parquet(f"{landed}/batch=1")
    return monthly_average(read_interest(spark, landed), ["keyword"], batch="batch")


@query("interest_variant", f"""
select keyword, cast(month(date) as int) as month, {_mean('value')} as interest_score from (
  select l_shipdate as date, 'quantity' as keyword, l_quantity as value from lineitem
  union all select l_shipdate, 'discount', l_discount from lineitem where l_returnflag = 'N'
  union all select l_shipdate, 'tax', null from lineitem where l_returnflag = 'N')
group by 1, 2""")
def _(spark, sf_dir):
    landed = shared_folder(spark, "interest-lines")
    rows = _lineitem_wide(spark, sf_dir)
    rows.drop("flag").write.json(f"{landed}/batch=0")
    # the later batch has no quantity, and tax without a value
    later = rows.where("flag = 'N'").drop("flag", "quantity").withColumn("tax", F.lit(None).cast("double"))
    later.write.option("ignoreNullFields", False).json(f"{landed}/batch=1")
    return monthly_average(read_interest_lines(spark, landed), ["keyword"], batch="batch")


@query("scores_stored_by_geo", f"""
select o_orderpriority as keyword, '' as geo, cast(month(o_orderdate) as int) as month,
  {_mean('o_totalprice')} as interest_score
from orders where o_orderstatus = 'F' group by 1, 3""")
def _(spark, sf_dir):
    table = shared_folder(spark, "scores")
    status = F.col("o_orderstatus")
    orders = _read(spark, sf_dir, "orders").select(
        F.when(status == "F", "").when(status == "O", "FR").when(status == "P", "DE").alias("geo"),
        F.col("o_orderpriority").alias("keyword"), F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"),
    )
    append_scores(monthly_average(orders, ["geo", "keyword"]), table, geo=None)
    return read_scores(spark, table, "").select("keyword", "geo", "month", "interest_score")


@query("scores_compacted", f"""
select o_orderpriority as keyword, case o_orderstatus when 'F' then '' when 'O' then 'FR' else 'DE' end as geo,
  cast(month(o_orderdate) as int) as month, count(o_totalprice) as n, {_mean('o_totalprice')} as interest_score,
  cast(arg_max(o_totalprice, (o_orderkey % 5) * 1000000000000 + o_orderkey) as double) as last_score
from orders group by 1, 2, 3""")
def _(spark, sf_dir):
    table = shared_folder(spark, "months")
    status = F.col("o_orderstatus")
    rows = _read(spark, sf_dir, "orders").select(
        F.when(status == "F", "").when(status == "O", "FR").otherwise("DE").alias("geo"),
        F.col("o_orderpriority").alias("keyword"), F.month("o_orderdate").alias("month"),
        F.col("o_totalprice").alias("interest_score"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 5).alias("number"),
    )
    for number in range(5):
        merge_scores(rows.where(F.col("number") == number), table, geo=None, compact_after=2)
    return read_months(spark, table)


# --- scans and batches ----------------------------------------------------------------


@query("keywords_by_lang", "select doc_id as id, text as keyword, lang from documents where lang = 'fr'")
def _(spark, sf_dir):
    table = shared_folder(spark, "keywords-by-lang")
    rows = keywords(spark, sf_dir).withColumn("collected_at", F.current_timestamp()).drop("ord")
    rows.write.partitionBy("lang").parquet(table)
    return read_keywords(spark, table, "fr").select("id", "keyword", "lang")


@query("keywords_head", """
select doc_id as id, text as keyword from documents where lang = 'en' order by doc_id limit 15""")
def _(spark, sf_dir):
    english = keywords(spark, sf_dir).where(F.col("lang") == "en")
    return first_keywords(english.select("id", "keyword"))


@query("batch_assign", """
select doc_id as id, lang,
  (row_number() over (partition by lang order by doc_id) - 1) // 5 as batch from documents""")
def _(spark, sf_dir):
    return numbering.assign_batches(keywords(spark, sf_dir).select("id", "lang"), ["lang"])


# --- noise and language ------------------------------------------------------------------


@query("noise_filter", f"""{DOCS}
select id, coalesce({_case(NOISE_PACK, 'category')}, 'keeper') as bucket from docs""")
def _(spark, sf_dir):
    return route_noise(texts(spark, sf_dir), NOISE_RULES).select("id", "bucket")


@query("noise_filter_domain", f"""{DOCS}
select id, case when {_any(fixed.COMPETITOR)} then 'competitor'
  when {_any(fixed.OFF_TOPIC)} then 'off_topic' else 'keeper' end as bucket from docs""")
def _(spark, sf_dir):
    return route_noise(texts(spark, sf_dir)).select("id", "bucket")


@query("language_detect", f"{DOCS}, {_language_sql()} select id, detected_lang from det")
def _(spark, sf_dir):
    detected = language.detected_language(F.col("keyword"))
    return texts(spark, sf_dir).select("id", detected.alias("detected_lang"))


@query("cross_language_split", f"""{DOCS}, {_language_sql()}
select detected_lang, keyword, source as seed, lang as declared_lang
from det where detected_lang <> lang""")
def _(spark, sf_dir):
    split = language.split_by_language(texts(spark, sf_dir), F.col("lang"))
    return reports.FOREIGN_LANGUAGE.of(stored_once(split.where("is_foreign"), "foreign"))


CURATED = f"""{DOCS}, {_language_sql()}, cur as (
  select *, coalesce({_case(NOISE_PACK, 'category')}, 'keeper') as first_bucket from det),
curated as (select *, case when first_bucket = 'keeper' and detected_lang <> lang then 'foreign'
  else first_bucket end as bucket from cur)"""


def _curated(spark, sf_dir) -> DataFrame:
    return curate(texts(spark, sf_dir), F.col("lang"), NOISE_RULES)


@query("curate", f"""{CURATED} select id, bucket,
  case when first_bucket = 'keeper' then detected_lang end as detected_lang from curated""")
def _(spark, sf_dir):
    return _curated(spark, sf_dir).select("id", "bucket", "detected_lang")


@query("curation_counts", f"""{CURATED} select count(*) as total,
  count(*) filter (bucket = 'keeper') as kept, count(*) filter (bucket = 'competitor') as competitor,
  count(*) filter (bucket = 'off_topic') as off_topic,
  count(*) filter (bucket = 'foreign') as foreign_language from curated""")
def _(spark, sf_dir):
    return summaries.curation_counts(_curated(spark, sf_dir))


@query("tagging_sheet", f"""{CURATED}
select keyword, source as seed, lang, '' as intent, '' as notes from curated where bucket = 'keeper'""")
def _(spark, sf_dir):
    kept = _curated(spark, sf_dir).where(F.col("bucket") == "keeper")
    return reports.TAGGING_SHEET.of(stored_once(kept, "kept"))


@query("sheet_roundtrip", """
select text as keyword, source as seed, lang, '' as intent, '' as notes from documents""")
def _(spark, sf_dir):
    path = shared_folder(spark, "sheet")
    reports.TAGGING_SHEET.write(keywords(spark, sf_dir), path)
    return read_sheet(spark, path).drop("ord")


# --- intent --------------------------------------------------------------------------------


def _intent_sql(groups: dict[str, list[str]]) -> str:
    return f"{_case(groups, 'category')} as intent, {_case(groups, 'rule')} as matched_rule"


def _classified(spark, sf_dir, table: RuleTable) -> DataFrame:
    return intent.classify(texts(spark, sf_dir), table).select("id", "intent", "matched_rule")


@query("intent_classify", f"{DOCS} select id, {_intent_sql(intent.CONFIDENT_GROUPS)} from docs")
def _(spark, sf_dir):
    return _classified(spark, sf_dir, intent.CONFIDENT)


@query("intent_classify_pack", f"{DOCS} select id, {_intent_sql(INTENT_PACK)} from docs")
def _(spark, sf_dir):
    return _classified(spark, sf_dir, INTENT_RULES)


@query("commercial_fallback", f"{DOCS} select id, {_intent_sql(COMMERCIAL_PACK)} from docs")
def _(spark, sf_dir):
    return _classified(spark, sf_dir, COMMERCIAL_RULES)


@query("commercial_fallback_domain", f"""{DOCS}
select id, {_intent_sql(intent.COMMERCIAL_GROUPS)} from docs""")
def _(spark, sf_dir):
    return _classified(spark, sf_dir, intent.COMMERCIAL)


def _auto_sql(groups: dict[str, list[str]]) -> str:
    return f"""{TAGS}, auto as (
  select *, case when tag <> '' then tag else {_case(groups, 'category')} end as intent,
    case when tag <> '' then 'manuel' else {_case(groups, 'rule')} end as matched_rule from docs)"""


def _auto(spark, sf_dir, table: RuleTable) -> DataFrame:
    return intent.auto_classify(sheet(spark, sf_dir), table)


@query("auto_classify", f"""{_auto_sql(INTENT_PACK)}
select keyword, source as seed, lang, intent, matched_rule from auto where intent is not null""")
def _(spark, sf_dir):
    done = _auto(spark, sf_dir, INTENT_RULES).where(F.col("intent").isNotNull())
    return reports.CLASSIFIED.of(stored_once(done, "classified"))


@query("auto_classify_commercial", f"""{_auto_sql(INTENT_PACK | COMMERCIAL_PACK)}
select id, intent, matched_rule from auto""")
def _(spark, sf_dir):
    return _auto(spark, sf_dir, FOUR_TIERS).select("id", "intent", "matched_rule")


@query("needs_review", f"""{_auto_sql(INTENT_PACK)}
select keyword, source as seed, lang, '' as intent, '' as notes from auto where intent is null""")
def _(spark, sf_dir):
    left = intent.needs_review(_auto(spark, sf_dir, INTENT_RULES))
    return reports.NEEDS_REVIEW.of(stored_once(left, "review"))


@query("intent_summary", f"""{_auto_sql(INTENT_PACK | COMMERCIAL_PACK)}
select intent, count(*) as n, min(id) as first_ord from auto where intent is not null group by 1""")
def _(spark, sf_dir):
    done = _auto(spark, sf_dir, FOUR_TIERS).where(F.col("intent").isNotNull())
    return summaries.count_by(done, "intent")


@query("classification_rate", f"""{_auto_sql(INTENT_PACK | COMMERCIAL_PACK)}
select count(*) as total, count(intent) as classified, count(*) - count(intent) as needs_review,
  cast(count(intent) as double) / count(*) * 100 as auto_rate,
  count(*) filter (intent = 'commercial') as commercial from auto""")
def _(spark, sf_dir):
    return summaries.classification_rate(_auto(spark, sf_dir, FOUR_TIERS))


@query("tag_map", """
select cast(conv_id as varchar) as keyword, arg_max(role, turn) as intent
from conversations group by 1""")
def _(spark, sf_dir):
    tagged = _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("keyword"),
        F.concat(F.lit(" "), F.upper("role")).alias("intent"),
        F.col("turn").alias("ord"),
    )
    return intent.tag_map(tagged)


# --- themes ----------------------------------------------------------------------------------

_THEMES = "case " + " ".join(
    f"when starts_with(lower(p_name), '{prefix}') then '{theme}'" for prefix, theme in THEME_PACK
) + " else 'autre' end"


def _parts(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("seed")
    ).withColumn("cluster", themes.theme_of_seed(F.col("seed"), THEME_PACK))


@query("cluster_assign", f"select p_partkey as ord, p_name as seed, {_THEMES} as cluster from part")
def _(spark, sf_dir):
    return _parts(spark, sf_dir)


@query("cluster_summary", f"""
select {_THEMES} as cluster, count(*) as n, min(p_partkey) as first_ord from part group by 1""")
def _(spark, sf_dir):
    return summaries.count_by(_parts(spark, sf_dir), "cluster")


def _routed_sql(target: str) -> str:
    return f"""{TAGS}, decl as (
  select *, case when source = 'src3' then upper(lang) else lang end as declared,
    case source when 'src0' then 'en' when 'src1' then 'it' end as override from docs),
res as (select *, coalesce(override, declared) as resolved from decl where tag not in ('', 'exclure')),
routed as (select *, case when resolved <> lower(declared) then 'cross_language'
  {target} end as route from res)
select id, resolved as lang, tag as intent, route from routed where route is not null"""


def _routed(spark, sf_dir, target: str | None) -> DataFrame:
    shouted = F.when(F.col("source") == "src3", F.upper("lang")).otherwise(F.col("lang"))
    tagged = sheet(spark, sf_dir).withColumn("lang", shouted)
    return themes.route_tagged(tagged, target).select("id", "lang", "intent", "route")


@query("resolve_language", _routed_sql("else 'matching'"))
def _(spark, sf_dir):
    return _routed(spark, sf_dir, None)


@query("resolve_language_target", _routed_sql("when resolved = 'en' then 'matching'"))
def _(spark, sf_dir):
    return _routed(spark, sf_dir, " EN ")


SEED_PACK = [("src1", "teens"), ("src0", "origin"), ("src", "others")]
_SEED_THEME = "case " + " ".join(f"when starts_with(lower(source), '{p}') then '{t}'" for p, t in SEED_PACK) + " end"
_LISTED = _routed_sql("else 'matching'").rpartition("select")[0].replace(
    "docs)", f"""docs), noted as (select *, {_SEED_THEME} as cluster,
    case source when 'src0' then 'EN' when 'src1' then ' it ' when 'src2' then 'free text' else '' end as notes from decl)""", 1
).replace("from decl where", "from noted where")


def _listed(spark, sf_dir) -> DataFrame:
    shouted = F.when(F.col("source") == "src3", F.upper("lang")).otherwise(F.col("lang"))
    tagged = sheet(spark, sf_dir).withColumn("lang", shouted)
    return stored_once(themes.route_tagged(tagged, prefixes=SEED_PACK), "listed")


@query("clustered_report", f"""{_LISTED}
select cluster, keyword, source as seed, resolved as lang, tag as intent, notes from routed where route = 'matching'""")
def _(spark, sf_dir):
    return reports.CLUSTERED.of(_listed(spark, sf_dir).where(F.col("route") == themes.MATCHING))


@query("cross_language_report", f"""{_LISTED}
select resolved as resolved_lang, keyword, source as seed, cluster, tag as intent from routed
where route = 'cross_language'""")
def _(spark, sf_dir):
    return reports.CROSS_LANGUAGE.of(_listed(spark, sf_dir).where(F.col("route") == themes.CROSS_LANGUAGE))


# --- expansion and append ----------------------------------------------------------------------


@query("query_frontier", """
with seeds as (select p_name as seed, min(p_partkey) as ord from part group by 1),
letters as (select i as pos, case when i = 0 then '' else ' ' || chr(96 + cast(i as int)) end as tail
  from range(27) t(i))
select 'en' as lang, seed as root_seed, seed || tail as seed, ord * 27 + pos as ord from seeds, letters""")
def _(spark, sf_dir):
    seeds = _read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("seed")).agg(
        F.min("p_partkey").alias("ord")
    )
    return query_frontier(seeds.withColumn("lang", F.lit("en")))


def _payloads(spark, sf_dir) -> DataFrame:
    """Every turn as a landed answer; some without a list, some broken, some with odd items."""
    sentences = F.to_json(F.split("text", r"\."))
    head = F.concat(F.lit('["'), F.col("conv_id").cast("string"), F.lit('"'))
    odd = F.concat(F.lit('[3,null,{"a":["b"]},'), F.substring(sentences, 2, 1 << 30))
    items = F.when(F.col("role") == "assistant", odd).otherwise(sentences)
    whole = F.concat(head, F.lit(","), items, F.lit("]"))
    payload = (
        F.when(F.col("role") == "system", F.concat(head, F.lit("]")))
        .when(F.contains("text", F.lit("ça")), F.concat(head, F.lit(","), items))
        .otherwise(whole)
    )
    return _read(spark, sf_dir, "conversations").select(
        F.lit("fr").alias("lang"), F.col("conv_id").cast("string").alias("root_seed"),
        F.col("role").alias("seed"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        payload.alias("payload"),
    )


SUGGESTED = """sent as (
  select conv_id, turn, role, string_split(text, '.') as parts from conversations
  where role <> 'system' and not contains(text, 'ça')),
items as (select *, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as pos from sent),
sugg as (select regexp_replace(part, '^\\s+|\\s+$', '', 'g') as keyword, 'google_autocomplete' as source,
  'fr' as lang, cast(conv_id as varchar) as root_seed, role as seed,
  conv_id * 1000 + turn as request, cast(pos as int) as place from items)"""


@query("suggestion_ingest", f"with {SUGGESTED} select * from sugg where keyword <> ''")
def _(spark, sf_dir):
    return decode_suggestions(_payloads(spark, sf_dir)).drop("ord")


@query("expand_payloads", f"""with {SUGGESTED}
select * from sugg where keyword <> ''
qualify row_number() over (partition by lang, root_seed, lower(keyword) order by request, place) = 1""")
def _(spark, sf_dir):
    return keyed.first_spelling(decode_suggestions(_payloads(spark, sf_dir)), ["lang", "root_seed"]).drop("ord")


@query("dedupe_first", f"""{DOCS} select id, keyword, lang from docs
qualify row_number() over (partition by lang, low order by id) = 1""")
def _(spark, sf_dir):
    rows = keywords(spark, sf_dir).select("id", "keyword", "lang")
    return keyed.first_spelling(rows, ["lang"], "id")


_OLD = "cast(substr(source, 4) as int) < 10"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = keywords(spark, sf_dir)
    old = F.substring("source", 4, 9).cast("int") < 10
    return rows.where(old), rows.where(~old)


@query("append_new", f"""
select doc_id as ord, text as keyword, lang, source as seed from documents d where not ({_OLD})
and not exists (select 1 from documents s where {_OLD} and s.text = d.text and s.lang = d.lang)
qualify row_number() over (partition by text, lang order by doc_id) = 1""")
def _(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    new = keyed.only_new(incoming, stored, ["keyword", "lang"])
    return new.select("ord", "keyword", "lang", "seed")


@query("append_table", f"""
select text as keyword, lang, arg_min(source, struct_pack(a := not ({_OLD}), b := doc_id)) as seed
from documents group by 1, 2""")
def _(spark, sf_dir):
    table = shared_folder(spark, "keywords")
    for rows in _halves(spark, sf_dir):
        append_keywords(rows.withColumn("source", F.lit(fixed.SUGGESTION_SOURCE)), table)
    return read_keywords(spark, table).select("keyword", "lang", "seed")


@query("append_bucketed", f"""
select row_number() over (order by is_new, doc_id) - 1 as id, keyword, lang, seed from (
  select doc_id, text as keyword, lang, source as seed, not ({_OLD}) as is_new from documents
  qualify row_number() over (partition by text, lang order by not ({_OLD}), doc_id) = 1)""")
def _(spark, sf_dir):
    table = shared_folder(spark, "bucketed")
    for rows in _halves(spark, sf_dir):
        append_keywords(rows.withColumn("source", F.lit(fixed.SUGGESTION_SOURCE)), table)
    return read_keywords(spark, table).select("id", "keyword", "lang", "seed")


@query("ingest_counters", f"""
with sugg as (select *, text as keyword from documents where not ({_OLD})
  qualify row_number() over (partition by lang, source, lower(text) order by doc_id) = 1),
new as (select * from sugg d where not exists
  (select 1 from documents s where {_OLD} and s.text = d.text and s.lang = d.lang)
  qualify row_number() over (partition by text, lang order by doc_id) = 1)
select lang, seed, count(*) as suggestions, count(*) filter (is_new) as inserted from (
  select sugg.lang, sugg.source as seed, new.doc_id is not null as is_new
  from sugg left join new on sugg.doc_id = new.doc_id) group by 1, 2""")
def _(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    expanded = keyed.first_spelling(incoming, ["lang", "seed"])
    marked = keyed.marked_new(expanded, stored, ["keyword", "lang"])
    return summaries.ingest_counters(marked, ["lang", "seed"])


@query("stream_append_new", "select distinct text as keyword, lang, source, source as seed from documents")
def _(spark, sf_dir):
    static = _read(spark, sf_dir, "documents")
    # a glob, because a stream source takes no single file by its plain name
    path = f"{sf_dir}/documents.parque[t]"
    landed = spark.readStream.schema(static.schema).parquet(path).select(
        F.col("doc_id").alias("ord"), F.col("text").alias("keyword"), "lang", "source",
        F.col("source").alias("seed"),
    )
    table = shared_folder(spark, "stream-table")
    append_stream(landed, table).awaitTermination()
    return read_keywords(spark, table).select("keyword", "lang", "source", "seed")


@query("stream_first_spelling", f"""with {SUGGESTED}, spelled as (
  select * from sugg where keyword <> ''
  qualify row_number() over (partition by lang, root_seed, lower(keyword) order by request, place) = 1)
select keyword, lang, source, seed from spelled
qualify row_number() over (partition by keyword, lang, source order by request, place) = 1""")
def _(spark, sf_dir):
    landed, table = shared_folder(spark, "landed"), shared_folder(spark, "stream-table")
    checkpoint = shared_folder(spark, "stream-state")
    payloads = _payloads(spark, sf_dir)
    later = F.col("ord") % 1000 >= 2  # the later turns of each conversation land first
    payloads.where(later).write.json(landed)
    append_spellings(stream_payloads(spark, landed), table, checkpoint).awaitTermination()
    payloads.where(~later).write.mode("append").json(landed)
    end_round(spark, landed)
    append_spellings(stream_payloads(spark, landed), table, checkpoint).awaitTermination()
    return read_keywords(spark, table).select("keyword", "lang", "source", "seed")


@query("stream_dedupe_watermark", "select distinct text as keyword, lang, source from documents")
def _(spark, sf_dir):
    static = _read(spark, sf_dir, "documents")
    landed = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/documents.parque[t]").select(
        F.col("doc_id").alias("ord"), F.col("text").alias("keyword"), "lang", "source",
        F.col("source").alias("seed"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600).alias("landed_at"),
    )
    table = shared_folder(spark, "recent-table")
    append_recent(landed, table).awaitTermination()
    return read_keywords(spark, table).select("keyword", "lang", "source")


# --- diagnostics -----------------------------------------------------------------------------------


def _conflict_sql(groups: dict[str, list[str]]) -> str:
    hits = ", ".join(
        f"case when {_any(patterns)} then '{name}' end"
        for name, patterns in zip(fixed.CATEGORY_NAMES, groups.values())
    )
    return f"""{DOCS}, hit as (
  select *, list_filter([{hits}], lambda x: x is not null) as cats from docs),
routed as (select *, case when len(cats) > 0 then array_to_string(cats, ' + ') end as matched_categories,
  case when len(cats) > 1 then 'conflict' when len(cats) = 1 then 'single' else 'no_match' end as route
  from hit)"""


_PACK_CONFLICTS = _conflict_sql(INTENT_PACK | COMMERCIAL_PACK)


@query("rule_conflicts", f"{_PACK_CONFLICTS} select id, matched_categories, route from routed")
def _(spark, sf_dir):
    routed = diagnostics.matched_categories(texts(spark, sf_dir), CONFLICT_RULES)
    return routed.select("id", "matched_categories", "route")


@query("rules_from_table", f"""
with rules as (
  select cast(item_id as int) as number, nullif(regexp_extract(lower(text), '([a-z]+ [a-z]+)', 1), '') as phrase from benchmark
), marked as materialized (
  select doc_id as id, regexp_replace(lower(text), '([a-z0-9_\\p{{L}}\\p{{N}}]+)', '<\\1>', 'g') as words from documents
), found as (
  select id, number from marked join rules on contains(words, '<' || replace(phrase, ' ', '> <') || '>')
)
select doc_id as id, coalesce(string_agg(cast(number as varchar), ' ' order by number), '') as hits
from documents left join found on doc_id = id group by 1""")
def _(spark, sf_dir):
    rules = _read(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("number"), F.regexp_extract(F.lower("text"), "([a-z]+ [a-z]+)", 1).alias("phrase")
    )
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("keyword"))
    return rule_hits(docs, rules).select("id", F.array_join("hits", " ").alias("hits"))


@query("rule_conflict_counts", f"""{_PACK_CONFLICTS} select count(*) as total,
  count(*) filter (route = 'no_match') as no_match, count(*) filter (route = 'conflict') as conflict,
  count(*) filter (route = 'single') as single from routed""")
def _(spark, sf_dir):
    routed = diagnostics.matched_categories(texts(spark, sf_dir), CONFLICT_RULES)
    return diagnostics.route_counts(routed)


_DOMAIN_CONFLICTS = _conflict_sql(intent.CONFIDENT_GROUPS | intent.COMMERCIAL_GROUPS)


@query("rule_conflicts_domain", f"{_DOMAIN_CONFLICTS} select id, matched_categories, route from routed")
def _(spark, sf_dir):
    routed = diagnostics.matched_categories(texts(spark, sf_dir))
    return routed.select("id", "matched_categories", "route")


_STOP = ", ".join(_text(word) for word in fixed.STOPWORDS)
_WORDS = f"""{_DOMAIN_CONFLICTS}, parts as (
  select id, regexp_split_to_array(low, '\\s+') as ws from routed where route = 'no_match'),
placed as (select id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from parts),
counted as (select word, count(*) as n, min(struct_pack(a := id, b := pos)) as first
  from placed where word <> '' and word not in ({_STOP}) group by 1)"""


def _open_keywords(spark, sf_dir) -> DataFrame:
    routed = diagnostics.matched_categories(texts(spark, sf_dir))
    return routed.where(F.col("route") == "no_match")


@query("word_frequency", f"{_WORDS} select word, n from counted order by n desc, first limit 15")
def _(spark, sf_dir):
    return diagnostics.word_frequency(_open_keywords(spark, sf_dir))


@query("word_frequency_pruned", f"{_WORDS} select word, n from counted order by n desc, first limit 15")
def _(spark, sf_dir):
    # read three times, so the rules are applied once before
    return diagnostics.frequent_words(stored_once(_open_keywords(spark, sf_dir).select("ord", "keyword"), "open"))


@query("word_counts", f"{_WORDS} select word, n from counted")
def _(spark, sf_dir):
    return diagnostics.word_frequency(_open_keywords(spark, sf_dir), top=None)


@query("diagnostic_reports", f"""{_PACK_CONFLICTS}
select route as report, keyword, source as seed, lang, '' as intent, '' as notes,
  case when route = 'conflict' then matched_categories end as matched_categories
from routed where route in ('no_match', 'conflict')""")
def _(spark, sf_dir):
    blank = texts(spark, sf_dir).withColumns({"intent": F.lit(""), "notes": F.lit("")})
    routed = stored_once(diagnostics.matched_categories(blank, CONFLICT_RULES), "diagnosed")
    parts = []
    for route, report in (("no_match", reports.NO_MATCH), ("conflict", reports.CONFLICTS)):
        rows = report.of(routed.where(F.col("route") == route), tie=None)
        parts.append(rows.select(F.lit(route).alias("report"), "*"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
