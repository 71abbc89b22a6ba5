"""Scans, sinks and table maintenance. Results are read back from the tables they were written to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselight.functions import parse
from bourselight.operators import merge
from bourselight.operators.buckets import Layout, Tables, Write
from bourselight.operators.normalise import PERIOD_KEY
from bourselight.plans import screen, snapshot
from bourselight.plans.snapshot import build
from bourselight.session import new_table_path, write_and_read
from bourselight.sources.landing import payload_account, read_landing, write_landing
from bourselight.sources.testbed import AS_OF
from workload import landed
from workload.damage import DAMAGED_QUOTES
from workload.pipelines import SNAPSHOT_COLUMNS, SNAPSHOT_TEXTS
from workload.registry import names, query, r6, rounded, snapshot_table

KEY = names(PERIOD_KEY)


def _landed(target: str, payload: str, source: str, entries: str = "count(*)") -> str:
    """Payloads of a target, as the distinct values that make one, and the entries in them."""
    return f"SELECT '{target}' AS target, count(DISTINCT {payload}) AS payloads, CAST({entries} AS BIGINT) AS entries FROM {source}"


_SERIES = "count(DISTINCT (symbol, statement_type, family, header))"
LANDED_SQL = "\nUNION ALL ".join(
    [
        _landed("price_daily", "(symbol, date_trunc('month', quote_date))", "prices"),
        _landed("company_profile", "symbol", "company"),
        _landed("index_quote_daily", "quote_date", "index_quotes"),
        _landed("archive_only", "r_regionkey", "region", "0"),
        _landed("company", "p_partkey // 100", "part"),
        _landed("quote", "CAST(symbol AS BIGINT) // 100", f"({DAMAGED_QUOTES})"),
        _landed("statement", "(symbol, statement_type, statement_code, period_kind)", "statement_wide"),
        _landed(
            "basic_financial", "(symbol, statement_type, statement_code)", "statement_wide WHERE period_kind <> 'quarterly'"
        ),
        _landed("ratio", "(symbol, statement_type, family)", "ratios", _SERIES),
        _landed("metric", "(symbol, statement_type, family)", "metrics"),
        _landed("price_ratio_daily", "(symbol, statement_type, year(quote_date))", "price_ratios"),
        _landed(
            "price_ratio_annual", "(symbol, statement_type)", "price_ratios",
            "count(DISTINCT (symbol, statement_type, year(quote_date)))",
        ),
        _landed("dividend", "(symbol, CAST(subject AS BIGINT) // 100)", "actions WHERE action = 'dividend'"),
        _landed("corporate_action", "(symbol, action, CAST(subject AS BIGINT) // 100)", "actions WHERE action <> 'dividend'"),
        _landed("shareholding", "(symbol, period_label)", "shareholding", "count(DISTINCT (symbol, period_label))"),
        _landed(
            "index_master", "(index_symbol, CAST(symbol AS BIGINT) // 100)", "constituents",
            "count(DISTINCT (index_symbol, CAST(symbol AS BIGINT) // 100))",
        ),
        _landed("index_return", "index_symbol", "index_returns", "count(DISTINCT index_symbol)"),
    ]
)


@query("s01_landing_scan", LANDED_SQL)
def s01(t):
    """Payloads of all endpoints written as JSON files, scanned once with an explicit schema, routed and counted."""
    path = new_table_path(t.spark, "landing")
    write_landing(reduce(DataFrame.unionByName, [call(t) for call in landed.ALL]), path)
    return payload_account(read_landing(t.spark, path)).select("target", "payloads", "entries")


MIDMONTH = "2024-01-15"


@query(
    "s02_content_append",
    """SELECT endpoint, symbol, sha256(payload) AS content_hash, id FROM archive
QUALIFY row_number() OVER (PARTITION BY endpoint, symbol, payload ORDER BY fetched_at, id) = 1""",
)
def s02(t):
    """The first half of the month is in the archive already; the whole month is then sent again."""
    store = merge.Archive(t.spark, new_table_path(t.spark, "raw_response"))
    store.append(t.archive.where(F.col("fetched_at") < F.lit(MIDMONTH).cast("timestamp")))
    store.append(t.archive)
    return store.index().select("endpoint", "symbol", "content_hash", "id")


@query(
    "s03_latest_payload",
    """SELECT endpoint, symbol, payload, id FROM archive
QUALIFY row_number() OVER (PARTITION BY endpoint, symbol ORDER BY fetched_at DESC, id DESC) = 1""",
)
def s03(t):
    return merge.latest_payload(t.archive).select("endpoint", "symbol", "payload", "id")


@query(
    "s04_params_hash",
    """SELECT id, sha256(concat('{"period":"', payload_key, '","statement_type":"', endpoint, '","symbol":"', symbol, '"}'))
  AS hash FROM (SELECT *, json_extract_string(payload, '$.k') AS payload_key FROM archive)""",
)
def s04(t):
    params = F.create_map(
        F.lit("symbol"), F.col("symbol"), F.lit("statement_type"), F.col("endpoint"),
        F.lit("period"), F.get_json_object("payload", "$.k"),
    )
    return t.archive.select("id", parse.params_hash(params).alias("hash"))


@query(
    "s05_symbol_of_endpoint",
    """SELECT id, CASE WHEN endpoint IN ('click', 'view') THEN '' WHEN endpoint = 'error' THEN '' ELSE symbol END AS symbol
FROM archive""",
)
def s05(t):
    kind = F.col("endpoint")
    path = (
        F.when(kind == "click", "/api/v1/quote/all")
        .when(kind == "view", "/api/v1/index/price-returns")
        .when(kind == "error", F.concat(F.lit("/health/"), F.col("symbol")))
        .otherwise(F.concat(F.lit("/api/v1/financials/"), F.col("symbol")))
    )
    return t.archive.select("id", parse.symbol_of_endpoint(path).alias("symbol"))


# The column whose hash lays a stored table out; all others go by symbol.
_KEYED = {"index_constituent": "index_symbol", "index_return": "index_symbol"}


def _stored(t, **frames: DataFrame) -> Tables:
    """Frames as stored tables laid out by bucket, in one version."""
    layouts = {name: Layout((_KEYED.get(name, "symbol"),), buckets=8) for name in frames}
    tables = Tables(t.spark, new_table_path(t.spark, "maintained"), layouts)
    tables.commit(**{name: Write(frame) for name, frame in frames.items()})
    return tables


@query(
    "s06_upsert",
    """SELECT symbol, round(CASE WHEN shares > 30 THEN market_cap * 3 ELSE market_cap END, 6) AS market_cap, volume FROM quote
UNION ALL SELECT concat('NEW', symbol), round(market_cap * 3, 6), volume FROM quote WHERE shares > 30""",
)
def s06(t):
    """Quotes of much traded companies come twice in the batch, and once more under new symbols."""
    columns = ["symbol", "market_cap", "volume"]
    tables = _stored(t, quote=t.quote.select(*columns))
    busy = t.quote.where(F.col("shares") > 30)
    version = lambda n: busy.withColumn("version", F.lit(n)).withColumn("market_cap", F.col("market_cap") * n)
    both = version(2).unionByName(version(3))
    renamed = version(3).withColumn("symbol", F.concat(F.lit("NEW"), F.col("symbol")))
    newest = [F.col("version").desc()]
    tables.commit(quote=Write(both.unionByName(renamed), lambda old, new: merge.upsert(old, new, ["symbol"], newest)))
    return rounded(tables.read("quote"))


@query(
    "s07_profile_merge",
    """SELECT symbol, CASE WHEN industry = 'PROMO' THEN concat('Renamed ', name) ELSE name END AS name, industry,
  CASE WHEN industry IN ('PROMO', 'SMALL') AND bse_code IS NOT NULL THEN 'Checked' ELSE sector END AS sector FROM company
UNION ALL SELECT concat('X', symbol), concat('X', symbol), NULL, 'Checked' FROM company
WHERE industry = 'SMALL' AND bse_code IS NOT NULL""",
)
def s07(t):
    """Profiles rename some companies, give some a sector, and bring symbols that are not known yet."""
    columns = ["symbol", "name", "industry", "sector"]
    tables = _stored(t, company=t.company.select(*columns))
    kind = F.col("industry")
    sector = F.when(F.col("bse_code").isNotNull(), "Checked")
    profiles = t.company.where(kind.isin("PROMO", "SMALL")).select(
        "symbol", F.when(kind == "PROMO", F.concat(F.lit("Renamed "), F.col("name"))).alias("name"), sector.alias("sector")
    )
    unknown = t.company.where(kind == "SMALL").select(
        F.concat(F.lit("X"), F.col("symbol")).alias("symbol"), F.lit(None).cast("string").alias("name"),
        sector.alias("sector"),
    )
    tables.commit(company=Write(profiles.unionByName(unknown), merge.merge_profiles))
    return tables.read("company")


@query(
    "s08_replace_members",
    """SELECT index_symbol, symbol FROM constituents JOIN index_master USING (index_symbol) WHERE exchange <> 'NSE'
UNION ALL SELECT m.index_symbol, m.symbol FROM memberships m JOIN index_master USING (index_symbol) WHERE exchange = 'NSE'""",
)
def s08(t):
    """Indices of one exchange lose their members outside the universe."""
    tables = _stored(t, index_constituent=t.constituents)
    touched = t.index_master.where(F.col("exchange") == "NSE").select("index_symbol")
    batch = snapshot.memberships(t.constituents, t.company).join(touched, "index_symbol", "left_semi")
    replace = lambda old, new: merge.replace_groups(old, new, ["index_symbol"], touched)
    tables.commit(index_constituent=Write(batch, replace, keys=touched))
    return tables.read("index_constituent").select("index_symbol", "symbol")


@query(
    "s09_replace_returns",
    """SELECT index_symbol, horizon, round(return_pct, 6) AS return_pct FROM index_returns
WHERE index_symbol NOT IN (SELECT index_symbol FROM index_returns WHERE return_pct > -9) OR return_pct > -9""",
)
def s09(t):
    tables = _stored(t, index_return=t.index_returns)
    batch = t.index_returns.where(F.col("return_pct") > -9)
    tables.commit(index_return=Write(batch, lambda old, new: merge.replace_groups(old, new, ["index_symbol"])))
    return rounded(tables.read("index_return"))


@query(
    "s10_restatement",
    f"""SELECT {KEY}, year, result_date, field_name, value
FROM periods JOIN lines USING (symbol, statement_type, statement_code, period_kind, header)
WHERE NOT (statement_code = 'pl' AND year >= 2000)
UNION ALL SELECT {KEY}, year, CAST(result_date + INTERVAL 90 DAY AS DATE), field_name, value * 2
FROM periods JOIN lines USING (symbol, statement_type, statement_code, period_kind, header)
WHERE statement_code = 'pl' AND year >= 2000 AND field_name <> 'taxExpense'""",
)
def s10(t):
    """Recent P&L periods are restated: figures change and one line is no longer reported."""
    tables = _stored(t, statement_period=t.periods, statement_line=t.lines)
    new_periods = t.periods.where((F.col("statement_code") == "pl") & (F.col("year") >= 2000)).withColumn(
        "result_date", F.date_add("result_date", 90)
    )
    restated = t.lines.join(new_periods.select(*PERIOD_KEY), list(PERIOD_KEY), "left_semi")
    new_lines = restated.where(F.col("field_name") != "taxExpense").withColumn("value", F.col("value") * 2)
    tables.commit(**merge.restatement(new_periods, new_lines))
    version = tables.version()
    written = tables.read("statement_period", version=version).drop("year")
    joined = written.join(tables.read("statement_line", version=version), list(PERIOD_KEY))
    return joined.select(*PERIOD_KEY, "year", "result_date", "field_name", "value")


@query(
    "s11_rebuilt_snapshot",
    f"SELECT symbol, {names(SNAPSHOT_TEXTS)}, {r6(*SNAPSHOT_COLUMNS)} FROM snapshot",
)
def s11(t):
    written = write_and_read(build(**t.snapshot_inputs(F.lit(AS_OF).cast("date"))), "company_snapshot")
    return rounded(written.select("symbol", *SNAPSHOT_TEXTS, *SNAPSHOT_COLUMNS))


@query(
    "s12_csv_export",
    f"""SELECT symbol AS "Symbol", name AS "Name", {', '.join(f'round({c}, 4) AS "{label}"' for c, label in
  (('market_cap', 'Market Capitalization'), ('pe', 'Price to Earning')))},
  (SELECT count(*) FROM screenable WHERE pe < 40) AS total,
  least((SELECT count(*) FROM screenable WHERE pe < 40), 500) AS exported,
  (SELECT count(*) FROM screenable WHERE pe < 40) > 500 AS truncated
FROM screenable WHERE pe < 40 ORDER BY market_cap DESC, symbol LIMIT 500""",
)
def s12(t):
    found = screen.matches(snapshot_table(t), F.col("pe") < 40)
    rows, counts = screen.export(found, 500, ["name", "market_cap", "pe"])
    path = new_table_path(t.spark, "export")
    rows.write.option("header", True).csv(path)
    back = t.spark.read.option("header", True).schema(rows.schema).csv(path)
    disclosed = counts.select(F.struct(*counts.columns)).scalar()
    return rounded(back.withColumn("c", disclosed).select(*back.columns, "c.*"), 4)


@query(
    "s13_written_back_family",
    """SELECT symbol, name, k.schema_kind FROM company c LEFT JOIN (
  SELECT DISTINCT symbol, schema_kind FROM periods WHERE statement_code = 'pl' AND schema_kind <> 'unknown') k
USING (symbol)""",
)
def s13(t):
    tables = _stored(t, company=t.company)
    changed = merge.changed_schema_kinds(tables.read("company"), t.periods)
    tables.commit(company=Write(changed, merge.set_schema_kinds))
    return tables.read("company").select("symbol", "name", "schema_kind")
