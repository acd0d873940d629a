"""The library's scalar functions under SQL names, as SQL functions of the session: no Python runs for them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, result, body.
SQL_FUNCTIONS = (
    ("fn_hamming", "a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    ("fn_slug", "t STRING", "STRING", "nullif(trim(BOTH '-' FROM regexp_replace(lower(t), '[^a-z0-9]+', '-')), '')"),
    ("fn_humanize", "t STRING", "STRING", "concat(upper(substring(trim(regexp_replace(t, '[_. ]+', ' ')), 1, 1)), lower(substring(trim(regexp_replace(t, '[_. ]+', ' ')), 2)))"),
    ("fn_rounding_allowance", "terms INT", "DOUBLE", "0.01D * greatest(terms, 1) + 1e-9D"),
    ("fn_age", "born DATE, at DATE", "INT", "year(at) - year(born) - cast(date_format(at, 'MMdd') < date_format(born, 'MMdd') AS INT)"),
    ("fn_decode_digits", "t STRING", "STRING", "translate(translate(t, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '۰۱۲۳۴۵۶۷۸۹', '0123456789')"),
    ("fn_shorten", "t STRING, n INT", "STRING", "if(char_length(t) <= n, t, concat(rtrim(substring(t, 1, n - 1)), '…'))"),
)


def register_functions(spark: SparkSession) -> None:
    for name, args, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
