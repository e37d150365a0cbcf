"""Column expressions: pure, JVM-side, null where the input cannot be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions import fixed

Text = Column

# Possessive first, greedy fallback: an unclosed or very long literal neither overflows the stack nor backtracks.
_SINGLE = r"'(?:[^'\\]++|\\.|'')*+'|'(?:[^'\\]++|\\.|'')*'"
_DOUBLE = r'"(?:[^"\\]++|\\.|"")*+"|"(?:[^"\\]++|\\.|"")*"'
_NUMBER = r"(?<![0-9A-Za-z_])(?:0x[0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)(?![0-9A-Za-z_])"


def normalize_query(query: Text) -> Text:
    """one space for any white space, lower case, literals and numbers as '?'; backticks stay."""
    out = F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))
    for pattern in (_SINGLE, _DOUBLE, _NUMBER):
        out = F.regexp_replace(out, pattern, "?")
    return out


def query_fingerprint(normalized: Text) -> Text:
    """F2"""
    return F.concat(F.lit("q_"), F.substring(F.sha2(normalized, 256), 1, 16))


def bound_snippet(text: Text, limit: int = 160) -> Text:
    """F3"""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def strip_port(host: Text) -> Text:
    """drop the port of host:port and [v6]:port; several colons without brackets are a bare v6 address."""
    colons = F.char_length(host) - F.char_length(F.replace(host, F.lit(":"), F.lit("")))
    return F.when(host.rlike(r"^\[[^\]]*\]"), F.regexp_extract(host, r"^(\[[^\]]*\])", 1)).when(colons == 1, F.substring_index(host, ":", 1)).otherwise(host)


def localized_double(text: Text) -> Column:
    """a comma is the decimal sign where there is no dot."""
    return F.when(text.contains("."), text).otherwise(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")


def epoch_to_ts(epoch: Text, fallback: Column) -> Column:
    """seconds (with a fraction) to a timestamp; unreadable, negative or absurd values give the fallback."""
    seconds = epoch.try_cast("double")
    return F.when((seconds >= 0) & (seconds < 2**53) & (seconds < 9e12), F.timestamp_micros((seconds * 1_000_000).cast("bigint"))).otherwise(fallback)


def snapshot_ts(prefix: Text) -> Column:
    """F7"""
    return F.try_to_timestamp(prefix, F.lit("yyyy_MM_dd_HH_mm_ss"))


#: F8, fixed values: kernel and tool spellings of socket states.
SOCKET_STATES = {
    "ESTAB": "ESTABLISHED", "ESTABLISHED": "ESTABLISHED", "SYN-SENT": "SYN_SENT", "SYN_SENT": "SYN_SENT", "SYN-RECV": "SYN_RECV", "SYN_RECV": "SYN_RECV",
    "FIN-WAIT-1": "FIN_WAIT1", "FIN_WAIT1": "FIN_WAIT1", "FIN-WAIT-2": "FIN_WAIT2", "FIN_WAIT2": "FIN_WAIT2", "TIME-WAIT": "TIME_WAIT", "TIME_WAIT": "TIME_WAIT",
    "CLOSE": "CLOSE", "CLOSED": "CLOSE", "CLOSE-WAIT": "CLOSE_WAIT", "CLOSE_WAIT": "CLOSE_WAIT", "LAST-ACK": "LAST_ACK", "LAST_ACK": "LAST_ACK", "LISTEN": "LISTEN", "CLOSING": "CLOSING", "UNCONN": "UDP",
}


def lookup(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed dictionary, as an expression."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, default)


def socket_state(token: Text) -> Text:
    """F8"""
    return lookup(F.upper(token), SOCKET_STATES)


def major_version(raw: Text) -> Text:
    """digits.digits at the beginning, else null."""
    return F.nullif(F.regexp_extract(raw, r"^\s*(\d+\.\d+)", 1), F.lit(""))


def version_key(version: Text) -> Column:
    """comparable numbers, so that 8.10 is above 8.2."""
    return F.struct(F.split(version, r"\.")[0].try_cast("int").alias("major"), F.split(version, r"\.")[1].try_cast("int").alias("minor"))


def distribution(wsrep_on: Text, cluster_size: Text, comment: Text, version: Text) -> Text:
    """F10"""
    on, low = F.lower(F.trim(wsrep_on)).isin("on", "1"), F.lower(F.coalesce(comment, F.lit("")))
    return (
        F.when(F.coalesce(on, F.lit(False)) & (F.coalesce(cluster_size.try_cast("double"), F.lit(0.0)) > 0), "cluster")
        .when(low.contains("percona"), "percona")
        .when(low.contains("mariadb") | F.lower(F.coalesce(version, F.lit(""))).contains("mariadb"), "mariadb")
        .otherwise("community")
    )


def severity_for_fraction(share: Column, warn: float, crit: float) -> Text:
    """F13"""
    return F.when(share.isNull(), None).when(share >= crit, "crit").when(share >= warn, "warn").otherwise("ok")


def variable_double(value: Text) -> Column:
    """F15"""
    return F.trim(value).try_cast("double")


def clamp_non_negative(x: Column) -> Column:
    """F16"""
    return F.greatest(x, F.lit(0).cast("double")) if x is not None else x


def any_token(text: Text, tokens: list[str]) -> Column:
    """Whether the text holds one of the tokens, without regard to case."""
    low = F.lower(text)
    out = F.lit(False)
    for t in tokens:
        out = out | low.contains(t.lower())
    return out


def evidence_kind(name: Text) -> Text:
    """F17"""
    ratio = any_token(name, ["ratio", "pct", "%", " per "]) | (name.contains(" / ") & ~name.contains("/s"))
    return (
        F.when(any_token(name, ["/s", "rate"]), "derived_rate").when(ratio, "derived_ratio").when(any_token(name, ["state", "processlist", "metadata lock"]), "observed_state").when(any_token(name, ["error", "aborted"]), "observed_error").otherwise("direct_measurement")
    )


def evidence_strength(name: Text, value: Column) -> Text:
    """F17"""
    return F.when(any_token(name, ["wait", "pending", "metadata lock", "single-page", "error", "aborted"]), "strong").when(value == 0, "weak").otherwise("moderate")


def confidence(severity: Text, n_metrics: Column) -> Text:
    """F18"""
    return F.when(severity == "crit", "high").when(n_metrics >= 2, "high").when(severity == "ok", "medium").when(severity == "info", "low").otherwise("medium")


def bucket_other(value: Text, null_word: bool = False) -> Text:
    """P1: 'Other' for empty values, and for the word NULL where it stands for nothing."""
    v = F.trim(F.coalesce(value, F.lit("")))
    empty = (v == "") | (v == "NULL") if null_word else v == ""
    return F.when(empty, "Other").otherwise(v)


def comma_set(value: Text) -> Column:
    """Parts of a comma list, trimmed, lower case, blanks dropped, duplicates kept, in order of their text."""
    return F.array_sort(F.filter(F.transform(F.split(F.lower(value), ","), lambda x: F.trim(x)), lambda x: x != ""))


def comma_set_equal(a: Text, b: Text) -> Column:
    """U3"""
    return comma_set(a) == comma_set(b)


def known_arch(release: Text) -> Text:
    """P10: what follows the last dot of a kernel release, if it names an architecture."""
    tail = F.substring_index(release, ".", -1)
    return F.when(tail.isin(fixed.ARCHES), tail)


def names_distro(line: Text) -> Column:
    """P11"""
    return reduce(lambda a, b: a | b, [line.contains(name) for name in fixed.DISTROS])


def is_counter(name: Text) -> Column:
    """The list of counters (by exact case) first, then name families, else a gauge."""
    low = F.lower(name)
    pages = F.regexp_extract(low, r"^innodb_buffer_pool_pages_(.+)$", 1)
    family = F.when(pages != "", ~pages.isin("data", "free", "misc", "old", "dirty", "total")).otherwise(low.rlike(r"^(com_|handler_|connection_errors_|innodb_rows_|performance_schema_)"))
    return name.isin(fixed.COUNTERS) | family


def net_display_name(name: Text) -> Text:
    """F14"""
    return lookup(name, fixed.NET_COUNTERS, name)


def net_order(name: Text) -> Column:
    """Curated names first, in their order, others after."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, fixed.NET_COUNTERS)), name), F.lit(0)), F.lit(99).cast("bigint"))


def in_category(name: Text, members: list[str], prefixes: list[str], excluded: list[str]) -> Column:
    """P5: a member, or a name with a prefix and without any of the excluded ones."""
    low = F.lower(name)

    def starts(values: list[str]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | low.startswith(v)
        return out

    return (low.isin([m.lower() for m in members]) if members else F.lit(False)) | (starts(prefixes) & ~starts(excluded))


def categories(name: Text, table: dict[str, tuple[list[str], list[str], list[str]]] | None = None) -> Column:
    """P5: all categories of a name, in the order of the table."""
    table = fixed.CATEGORIES if table is None else table
    return F.array_compact(F.array(*[F.when(in_category(name, *rule), F.lit(key)) for key, rule in table.items()]))
