"""Column expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from worst to least, and the words that name a vulnerability type, in order.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "ADVISORY"]
VULN_WORDS = {
    "overflow": ["overflow", "溢出", "乘法", "加法", "arithmetic", "u64", "u128"],
    "access_control": ["access", "权限", "admin", "withdraw", "unauthorized", "permission", "控制"],
    "first_deposit": ["first", "首次", "首存", "depositor", "初始", "empty"],
    "slippage": ["slippage", "滑点", "front-run", "sandwich", "min_amount", "deadline"],
    "flash_loan": ["flash", "闪电贷", "receipt", "hot potato", "repay"],
    "oracle": ["oracle", "预言机", "price manipulation", "twap", "价格操纵"],
    "reentrancy": ["reentrancy", "重入", "callback"],
    "donation": ["donation", "捐赠", "inflate"],
    "rounding": ["rounding", "舍入", "precision", "精度"],
}
#: File suffixes and their languages.
LANGUAGES = {"move": "move", "toml": "toml", "json": "json", "md": "markdown", "py": "python", "ts": "typescript", "js": "javascript", "rs": "rust", "sh": "shell", "yaml": "yaml", "yml": "yaml", "html": "html"}


def text_of(*parts: Column | str) -> Column:
    """Lower-cased parts joined by blanks; null counts as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]))


def any_in(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def choose(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first case that holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for test, then in cases:
        out = F.when(test, value(then)) if out is None else out.when(test, value(then))
    return out.otherwise(value(default))


def severity_rank(severity: Column) -> Column:
    return choose([(F.upper(severity) == s, i) for i, s in enumerate(SEVERITIES)], 99)


def vuln_type(*texts: str, category: str = "category") -> Column:
    """First word group found in the texts, else the category, else `other`."""
    text = text_of(*texts, category)
    own = F.lower(F.coalesce(F.col(category), F.lit("")))
    return choose([(any_in(text, words), name) for name, words in VULN_WORDS.items()], F.when(own != "", own).otherwise("other"))


def line_start(line: Column) -> Column:
    """`10-15` and `10` give `10`; null gives the empty text."""
    return F.coalesce(F.trim(F.split_part(line, F.lit("-"), F.lit(1))), F.lit(""))


def week_label(at: Column) -> Column:
    """Year and week of the year, weeks starting on Mondays; days before the first Monday are week 00."""
    monday_first = F.weekday(at)
    return F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(((F.dayofyear(at) + 6 - monday_first) / 7).cast("int").cast("string"), 2, "0"))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("plaintext"))


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; the rank limit is pushed below the shuffle by Spark."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_values(df: DataFrame, keys: list[str], order: list[Column], k: int, value: Column, name: str) -> DataFrame:
    """`keys, name`: the values of the first k rows of each group as an array, in order; nulls are left out.

    The arrays come from the sorted rows themselves, without a hash of groups, and stay sorted by `keys`. Where groups
    may be large, `topk_per_group` in the same order goes first.
    """
    rank = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({name: F.collect_list(value).over(rank.rowsBetween(0, k - 1)), "__rank": F.row_number().over(rank)})
    return rows.where("__rank = 1").select(*keys, name)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topk_per_group(df, keys, order, 1)
