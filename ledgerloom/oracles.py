"""DuckDB SQL for the queries of the catalog: the truth of the printed receipts, told from the tables they are printed from."""

from __future__ import annotations

from ledgerloom.functions import ids, money, text


def company_id_sql(key: str) -> str:
    d = lambda i: f"CAST(substr(CAST(1000000 + {key} * 37 AS VARCHAR), {i}, 1) AS INT)"
    total = " + ".join(f"{d(i + 1)} * {w}" for i, w in enumerate((3, 2, 1, 7, 5, 3, 2)))
    return f"(CAST(1000000 + {key} * 37 AS VARCHAR) || CAST((({total}) * 10) % 11 % 10 AS VARCHAR))"


def id_ok_sql(s: str) -> str:
    """Whether a string of digits passes the control digit."""
    weights = "[" + ", ".join(map(str, ids.COMPANY_WEIGHTS)) + "]"
    return f"(regexp_full_match({s}, '[0-9]{{2,10}}') AND coalesce(list_sum(list_transform(range(1, length({s})), lambda i: CAST(substr({s}, length({s}) - i, 1) AS INT) * {weights}[i])) * 10 % 11 % 10 = CAST(right({s}, 1) AS INT), false))"


def rules_sql(c: str, rules=text.ACCOUNT_RULES, default: str = text.DEFAULT_ACCOUNT) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({c}), '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


HEADS = f"""
items AS (SELECT l_orderkey, sum(CAST(floor(l_extendedprice) AS BIGINT))::BIGINT AS total, min(l_suppkey) AS seller FROM lineitem GROUP BY l_orderkey),
h0 AS (
  SELECT o_orderkey AS doc_id, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS date, o_orderpriority LIKE '1%' AS cash, total, seller FROM orders JOIN items ON o_orderkey = l_orderkey),
h1 AS (SELECT *, CASE WHEN date < DATE '2025-08-01' THEN 19 ELSE 21 END::BIGINT AS rate FROM h0),
heads AS (SELECT *, (2 * total * rate + 100 + rate) // (2 * (100 + rate)) AS vat, {company_id_sql("seller")} AS cui FROM h1)
"""

CENTS = "CAST(floor(l_extendedprice) AS BIGINT)"


def with_heads(select: str) -> str:
    return f"WITH {HEADS} {select}"


def ron2(x: str) -> str:
    return f"(round(({x}) * 100) / 100)"


VAT_PERIODS_SQL = "CASE " + " ".join(f"WHEN d BETWEEN DATE '{a}' AND DATE '{b}' THEN '{','.join(str(int(r)) for r in rates)}'" for a, b, rates in (("1900-01-01", *money.VAT_PERIODS[0][1:]), *money.VAT_PERIODS[1:2], ("2026-08-01", "2999-12-31", money.VAT_PERIODS[2][2]))) + " END"
