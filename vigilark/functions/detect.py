"""Predicates of the enrichment rules.

Each rule is written once as SQL text over a column name; the same text makes
the column expression and the function registered for ``spark.sql``.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.fields import array_lit, sql_text


def entropy_sql(name: str) -> str:
    """Bits per character of the whole string; 0 for null and empty text."""
    share = f"((length({name}) - length(replace({name}, ch, ''))) / length({name}))"
    return (f"CASE WHEN length({name}) > 0 THEN aggregate(array_distinct(split({name}, '')), 0D, "
            f"(total, ch) -> total - {share} * log2({share})) ELSE 0D END")


def labels_sql(name: str) -> str:
    return f"size(split({name}, '[.]'))"


def tunnelled_sql(name: str, threshold: float = dims.DNS_ENTROPY_THRESHOLD) -> str:
    """High entropy or many labels; false for a missing or empty name."""
    return (f"coalesce(length({name}) > 0 AND ({labels_sql(name)} > {dims.DNS_LABEL_LIMIT} "
            f"OR {entropy_sql(name)} > {threshold}D), false)")


def sql_token_sql(url: str) -> str:
    tests = " OR ".join(f"contains(upper({url}), {sql_text(t)})" for t in dims.SQL_TOKENS)
    return f"coalesce({tests}, false)"


def system_dir_sql(path: str) -> str:
    lowered = f"translate(lower({path}), '\\\\', '/')"
    tests = " OR ".join(f"contains({lowered}, {sql_text(d)})" for d in dims.SYSTEM_DIRS)
    return f"coalesce({tests}, false)"


def web_server_sql(name: str, servers=tuple(dims.INTENT_WEB_SERVERS)) -> str:
    listed = ", ".join(sql_text(s.lower()) for s in servers)
    return f"coalesce(lower({name}) IN ({listed}), false)"


def _v4_test(block: str) -> str:
    net = ipaddress.ip_network(block)
    return f"n BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}"


def _v6_test(block: str) -> str:
    """Group-wise range test; groups that may hold anything are left out."""
    net = ipaddress.ip_network(block)
    low, high = int(net.network_address), int(net.broadcast_address)
    tests = []
    for i in range(8):
        shift = 16 * (7 - i)
        first, last = (low >> shift) & 0xFFFF, (high >> shift) & 0xFFFF
        if (first, last) != (0, 0xFFFF):
            tests.append(f"g[{i}] BETWEEN {first} AND {last}")
    return "(" + " AND ".join(tests) + ")"


def _inside(test, blocks: list[str], exceptions: list[str]) -> str:
    return (f"({' OR '.join(test(b) for b in blocks)}) AND NOT "
            f"({' OR '.join(test(b) for b in exceptions)})")


def private_ip_sql(text: str) -> str:
    """True inside the private blocks, false elsewhere and for text that is no address.

    The parsed address is bound to a lambda variable, so it is worked out once
    per row however many blocks it is compared with.
    """
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    hextet = "[0-9a-f]{1,4}"
    plain = rf"regexp_replace({text}, r'(?i)^::ffff:(?=\d+\.\d+\.\d+\.\d+$)', '')"
    number = (rf"CASE WHEN {plain} RLIKE r'^{octet}\.{octet}\.{octet}\.{octet}$' THEN "
              f"aggregate(split({plain}, '[.]'), 0L, (total, part) -> total * 256 + cast(part AS bigint)) END")
    v4 = _inside(_v4_test, dims.PRIVATE_V4, dims.PUBLIC_V4_EXCEPTIONS)
    low = f"lower({text})"
    shape = (f"{low} RLIKE '^({hextet}(:{hextet}){{7}}|({hextet}(:{hextet})*)?::({hextet}(:{hextet})*)?)$'")
    named = f"regexp_count({low}, '[0-9a-f]+')"
    # "::" is filled up with the missing zero groups.
    filled = (f"CASE WHEN contains({low}, '::') THEN replace({low}, '::', "
              f"concat(repeat(':0', greatest(8 - {named}, 0)), ':')) ELSE {low} END")
    groups = (f"CASE WHEN {shape} AND (NOT contains({low}, '::') OR {named} < 8) THEN transform("
              f"regexp_extract_all({filled}, '[0-9a-f]+', 0), h -> cast(conv(h, 16, 10) AS int)) END")
    v6 = _inside(_v6_test, dims.PRIVATE_V6, dims.PUBLIC_V6_EXCEPTIONS)
    return (f"coalesce(CASE WHEN contains({text}, ':') AND NOT contains({text}, '.') "
            f"THEN transform(array({groups}), g -> {v6})[0] "
            f"ELSE transform(array({number}), n -> {v4})[0] END, false)")


def shannon_entropy(name: str) -> Column:
    return F.expr(entropy_sql(name))


def label_count(name: str) -> Column:
    return F.expr(labels_sql(name))


def looks_tunnelled(name: str, threshold: float = dims.DNS_ENTROPY_THRESHOLD) -> Column:
    return F.expr(tunnelled_sql(name, threshold))


def parent_domain(name: str) -> Column:
    """Text after the first label when there are at least three labels, else the whole name."""
    return F.expr(f"CASE WHEN {labels_sql(name)} >= 3 THEN regexp_replace({name}, '^[^.]*[.]', '') "
                  f"ELSE {name} END")


def is_private_ip(text: str) -> Column:
    return F.expr(private_ip_sql(text))


def has_sql_token(url: str) -> Column:
    return F.expr(sql_token_sql(url))


def in_system_dir(path: str) -> Column:
    return F.expr(system_dir_sql(path))


def is_web_server(name: str, servers=tuple(dims.INTENT_WEB_SERVERS)) -> Column:
    return F.expr(web_server_sql(name, servers))


def base_name(path: str) -> Column:
    """Last part of a path with either kind of slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def contains_any(text: Column, needles) -> Column:
    """True when ``text`` holds any of a list of literals (empty ones never match)."""
    wanted = [n for n in needles if n]
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(array_lit(wanted), lambda n: F.contains(text, n)), F.lit(False))


SQL_FUNCTIONS = {
    "dns_entropy": ("DOUBLE", entropy_sql),
    "dns_labels": ("INT", labels_sql),
    "dns_suspicious": ("BOOLEAN", tunnelled_sql),
    "is_private_address": ("BOOLEAN", private_ip_sql),
    "is_system_path": ("BOOLEAN", system_dir_sql),
    "has_sql_syntax": ("BOOLEAN", sql_token_sql),
    "is_web_server": ("BOOLEAN", web_server_sql),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the predicates callable from ``spark.sql`` as SQL functions (no Python at run time)."""
    for name, (kind, text) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} "
                  f"RETURN {text('x')}")
    return list(SQL_FUNCTIONS)
