"""Factor expressions as texts: structure, signatures, ratios, operators, families."""

from __future__ import annotations

import ast
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(expression: str) -> str:
    """Prefix form in which the two sides of ``+`` and ``*`` are sorted; what can't be read stands for itself."""

    def form(node: ast.expr) -> str:
        match node:
            case ast.BinOp(left=a, op=op, right=b):
                sides = [form(a), form(b)]
                if isinstance(op, ast.Add | ast.Mult):
                    sides.sort()
                return f"{type(op).__name__}({','.join(sides)})"
            case ast.UnaryOp(op=op, operand=x):
                return f"{type(op).__name__}({form(x)})"
            case ast.Call(func=ast.Name(id=name), args=args):
                return f"{name}[{','.join(map(form, args))}]"
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                return f"{type(op).__name__}({form(a)},{form(b)})"
            case ast.Name(id=name):
                return name
            case ast.Constant(value=v):
                return repr(v)
        raise ValueError(ast.dump(node))

    try:
        return form(ast.parse(expression, mode="eval").body)
    except (ValueError, SyntaxError, RecursionError):
        return f"text:{expression}"


def structure_hash(expression: Column) -> Column:
    """SHA-256 of an expression's canonical form."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda e: hashlib.sha256(canonical(e).encode()).hexdigest(), na_action="ignore")

    return run(expression)


def signature(expression: Column) -> Column:
    """The expression without blanks, with N for each number."""
    return F.regexp_replace(F.regexp_replace(expression, "[0-9]+", "N"), " ", "")


#: A division of two fields.
RATIO = "divide\\(\\s*([a-z0-9_]+)\\s*,\\s*([a-z0-9_]+)\\s*\\)"
CALL = "([a-z_][a-z0-9_]*)\\s*\\("


def ratios(expression: Column) -> Column:
    """``numerator/denominator`` of every division of two fields."""
    top, bottom = (F.regexp_extract_all(expression, F.lit(RATIO), F.lit(k)) for k in (1, 2))
    return F.zip_with(top, bottom, lambda a, b: F.concat_ws("/", a, b))


def operators(expression: Column) -> Column:
    """Distinct names that are called, in the order of their first call."""
    return F.array_distinct(F.regexp_extract_all(expression, F.lit(CALL), F.lit(1)))


#: A rule that is no pattern: fields of implied volatility with two or more tenors between them.
TENORS = "two tenors"
#: Names in an expression, and which of them are fields of implied volatility.
NAME, IV_FIELD = "[A-Za-z_][A-Za-z0-9_]*", "implied_volatility|(^|_)iv(_|$)"


def tenors(expression: Column) -> Column:
    """The different numbers in the names of fields of implied volatility."""
    fields = F.filter(F.regexp_extract_all(expression, F.lit(f"\\b({NAME})\\b"), F.lit(1)), lambda n: n.rlike(IV_FIELD))
    return F.array_distinct(F.flatten(F.transform(fields, lambda n: F.regexp_extract_all(n, F.lit("([0-9]+)"), F.lit(1)))))


def sql_tenors(e: str) -> str:
    fields = f"list_filter(regexp_extract_all({e}, '\\b{NAME}\\b'), lambda n: regexp_matches(n, '{IV_FIELD}'))"
    return f"len(list_distinct(flatten(list_transform({fields}, lambda n: regexp_extract_all(n, '[0-9]+')))))"


#: Economic families by the first rule that fits; a rule needs all of its patterns.
FAMILIES = [
    ("options_composite", ["pcr|put[_-]?call", "add\\(", "call", "put", "implied_volatility|(^|\\W|_)iv(_|\\W)"]),
    ("option_breakeven", ["breakeven", "forward_price"]),
    ("pcr_dynamics", ["pcr|put[_-]?call", "ts_delta\\(|ts_zscore\\("]),
    ("iv_skew_dynamics", ["ts_delta\\(subtract\\(implied_volatility"]),
    ("iv_momentum", ["ts_delta\\([^)]*(implied_volatility|(^|\\W|_)iv(_|\\W))"]),
    ("iv_term", [TENORS]),
    ("iv_term", ["implied_volatility_\\w+_(60|120)\\b", "implied_volatility_\\w+_(180|270|1080)"]),
    ("vrp", ["historical_volatility", "implied_volatility"]),
    ("vrp", ["ts_std_dev\\(returns", "implied_volatility"]),
    ("quality", ["gross_profit"]),
    ("seasonality", ["ts_delay\\(.*, (231|483|735)\\)"]),
    ("overnight", ["divide\\(open, ts_delay\\(close"]),
    ("microstructure", ["ts_corr\\(.*(volume|adv20)|ts_rank\\(divide\\(volume, adv20"]),
    ("options", ["implied_volatility|(^|\\W|_)iv(_|\\W)|pcr|put[_-]?call|historical_volatility"]),
    ("lowvol", ["beta_last|systematic_risk|unsystematic_risk|correlation_last"]),
    ("sentiment", ["scl12_|snt_|snt1_|mood_indicator"]),
    ("momentum", ["_day_price_ratio|_week_price_ratio|earnings_momentum"]),
    ("score", ["_score|_rank_derivative|distress_risk|asset_growth_rate|consensus_analyst_rating|earnings_revision_magnitude"]),
    ("dispersion", ["anl4_\\w+_high", "anl4_\\w+_low"]),
    ("dispersion", ["adj_net_income_stddev"]),
    ("revision", ["anl4_"]),
    ("value", ["cap|enterprise_value|assets|equity|debt|operating_income|ebit|ebitda|cashflow|\\beps\\b|bookvalue|fscore"]),
    ("momentum", ["ts_sum\\(returns, 2\\d\\d\\)"]),
    ("lowvol", ["ts_std_dev\\(returns"]),
    ("momentum", ["returns|ts_delta\\(close|ts_arg_m|vwap"]),
]


def family(expression: Column) -> Column:
    """The economic family of an expression."""
    e = F.coalesce(expression, F.lit(""))
    out = None
    for name, patterns in FAMILIES:
        fits = F.lit(True)
        for p in patterns:
            fits = fits & (F.size(tenors(e)) >= 2 if p == TENORS else e.rlike(p))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("other")


def sql_family(e: str) -> str:
    holds = lambda p: f"{sql_tenors(e)} >= 2" if p == TENORS else f"regexp_matches({e}, '{p}')"
    rules = " ".join("WHEN " + " AND ".join(map(holds, patterns)) + f" THEN '{name}'" for name, patterns in FAMILIES)
    return f"CASE {rules} ELSE 'other' END"


#: Reasons of a rejection by the first pattern found; others are cut to sixty characters.
REASONS = [
    ("redundant|self-corr", "redundant: too correlated with a saved factor"),
    ("degenerate", "degenerate expression (e.g. x-x, x/x)"),
    ("canned|operator", "new operator failed a canned test"),
    ("fold", "too few valid walk-forward folds"),
    ("nan|constant", "constant / all-NaN factor"),
]


def reason_class(reason: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    out = F.when(low.rlike(REASONS[0][0]), REASONS[0][1])
    for pattern, name in REASONS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(F.substring(F.when(F.coalesce(reason, F.lit("")) != "", reason).otherwise("other"), 1, 60))


def sql_reason_class(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({c}, '')), '{p}') THEN '{n}'" for p, n in REASONS) + f" ELSE substr(CASE WHEN coalesce({c}, '') <> '' THEN {c} ELSE 'other' END, 1, 60) END"
