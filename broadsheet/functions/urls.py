"""URL columns: validity, canonical form, hosts and publisher identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed


def _rx(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.trim(url), pattern, 1)


def scheme(url: Column) -> Column:
    return F.lower(_rx(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://"))


def netloc(url: Column) -> Column:
    return F.lower(_rx(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"))


def path(url: Column) -> Column:
    return _rx(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)")


def query(url: Column) -> Column:
    return _rx(url, r"^[^?#]*\?([^#]*)")


def host(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r"^(?:.*@)?([^:]*)", 1)


def is_public(url: Column) -> Column:
    """http(s), a host, and no user info."""
    return scheme(url).isin("http", "https") & (host(url) != "") & ~netloc(url).contains("@")


def form_decode(text: Column) -> Column:
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(text), plain)


def form_encode(text: Column) -> Column:
    """Form encoding that leaves ~ alone and escapes *."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(segment: Column) -> Column:
    return F.struct(
        form_decode(F.regexp_extract(segment, r"^([^=]*)", 1)).alias("k"),
        form_decode(F.regexp_extract(segment, r"^[^=]*=(.*)$", 1)).alias("v"),
    )


def canonical(url: Column) -> Column:
    """Stable form of a public URL, tracking parameters and fragment removed; '' when not public."""
    pairs = F.transform(F.filter(F.split(query(url), "&"), lambda s: s != ""), _pair)
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).startswith(fixed.TRACKING_PREFIX)
        & ~F.lower(p["k"]).isin(*fixed.TRACKING_PARAMETERS),
    )
    encoded = F.array_join(
        F.transform(kept, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&"
    )
    where = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    tail = F.when(encoded == "", F.lit("")).otherwise(F.concat(F.lit("?"), encoded))
    return F.when(
        is_public(url), F.concat(scheme(url), F.lit("://"), netloc(url), where, tail)
    ).otherwise(F.lit(""))


def host_suffixes(host_name: Column) -> Column:
    """['a.b.c', 'b.c', 'c'] for host a.b.c, so a suffix match is an equality match."""
    # the labels are an argument of the outer function, so that the host is not taken apart for each of them
    suffixes = lambda labels: F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.get(F.transform(F.array(F.split(host_name, r"\.")), suffixes), F.lit(0))


def under_any(host_name: Column, domains: list[str]) -> Column:
    """Host equals a listed domain or is below one."""
    return F.arrays_overlap(host_suffixes(host_name), F.array(*[F.lit(d) for d in domains]))


def dictionary_site(url: Column) -> Column:
    return under_any(host(url), fixed.DICTIONARY_DOMAINS)


def government(host_name: Column) -> Column:
    return (host_name == "gov.cn") | host_name.endswith(".gov.cn")


def root_domain(host_name: Column) -> Column:
    labels = F.split(F.lower(host_name), r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when((n >= 3) & last(2).isin(*fixed.TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def publisher_key(url: Column, source: Column) -> Column:
    """Host without www, or the account name on the shared account host."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"\.+$", ""), r"^www\.", "")
    name = F.lower(F.trim(source))
    return (
        F.when((bare == fixed.SHARED_ACCOUNT_HOST) & (name != ""), F.concat(F.lit("wechat:"), name))
        .when(bare != "", bare)
        .when(canonical(url) != "", canonical(url))
        .otherwise(name)
    )


def unwrap(url: Column) -> Column:
    """Target of a news-wrapper link; '' while the wrapper cannot be removed."""
    wrapped = host(url).isin(*fixed.NEWS_WRAPPER_HOSTS)
    target = form_decode(F.regexp_extract(query(url), r"(?:^|&)url=([^&]*)", 1))
    opened = F.when(wrapped, canonical(target)).otherwise(url)
    return F.when(host(opened).isin(*fixed.NEWS_WRAPPER_HOSTS), F.lit("")).otherwise(opened)
