"""SQL text helpers for the DuckDB oracle queries (the independent check of each Spark query)."""
from __future__ import annotations

from ..functions import fixed

RE2_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"


def lit(s: str) -> str:
    """A SQL string literal (raw newlines are allowed inside DuckDB literals)."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{RE2_WS}+|{RE2_WS}+$', '', 'g')"


def clean(x: str) -> str:
    inner = strip(f"coalesce(CAST({x} AS VARCHAR), '')")
    return f"replace(replace({inner}, {NL}||{NL}||{NL}, {NL}||{NL}), chr(9), ' ')"


def prompt_single(prompt: str, text_sql: str) -> str:
    return f"{lit(prompt)} || {lit(chr(10) * 2 + fixed.CONTENT_HEADER + chr(10))} || {text_sql} || {lit(chr(10) * 2 + fixed.RESULT_FOOTER)}"
