"""Base functions under SQL names, for use in spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .bases import CODE_BASES, CODES


def quoted(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in s) + "'"


def register(spark: SparkSession) -> None:
    """SQL functions without Python: they are expressions that the optimiser sees through."""
    bodies = {
        "seq_encode(t string)": f"regexp_replace(translate(t, {quoted(CODES)}, '{CODE_BASES}'), '[^ACGT]', 'N')",
        "seq_revcomp(s string)": "reverse(translate(s, 'ACGT', 'TGCA'))",
        "seq_double(s string)": "concat(s, reverse(translate(s, 'ACGT', 'TGCA')))",
        "seq_key32(s string)": "rpad(left(s, 32), 32, 'T')",
        "seq_canonical(s string)": "least(s, reverse(translate(s, 'ACGT', 'TGCA')))",
        "seq_lex_index(s string)": "cast(conv(translate(s, 'ACGT', '0123'), 4, 10) as bigint)",
        "seq_first_window(s string)": "regexp_extract(s, '[ACGT]{32}', 0)",
        "seq_next_n(s string, at int)": "position('N', concat(s, 'N'), at + 1) - (at + 1)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
