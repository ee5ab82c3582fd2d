"""Publisher reputation, domain suffix lookups and official product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import scores, text, urls


def longest_suffix(hosts: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rating of the longest listed suffix of each distinct host.

    Suffixes are exploded so the join is an equality; distinct hosts first, so a host behind a third of all
    items is looked up once.
    """
    suffixes = hosts.select("host").distinct().select("host", F.explode(urls.host_suffixes(F.col("host"))).alias("domain"))
    hit = suffixes.join(ratings, "domain")
    values = [c for c in ratings.columns if c != "domain"]
    best = hit.groupBy("host").agg(F.max_by(F.struct("domain", *values), F.length("domain")).alias("r"))
    return best.select("host", "r.*")


def attach(items: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their publisher's rating, and the updated reputation table.

    stored: publisher_key, name, url, authority, recognition, basis, first_seen. First write wins, except
    that an editorially configured domain replaces whatever was stored. items need url, source, day, seq.
    """
    keyed = items.withColumn("publisher_key", urls.publisher_key(F.col("url"), F.col("source")))
    first = keyed.groupBy("publisher_key").agg(
        F.min_by(F.struct(F.col("source").alias("name"), "url", F.col("day").alias("first_seen")), "seq").alias("f")
    )
    rated = first.select("publisher_key", "f.*").withColumn("n", scores.publisher_rating(F.col("url")))
    configured = F.col("n.basis") == fixed.RATING_BASIS["configured"]
    both = rated.alias("new").join(stored.alias("old"), "publisher_key", "full_outer")
    fresh = F.col("old.authority").isNull()
    replaced = F.coalesce(configured, F.lit(False))
    value = lambda c: F.when(fresh | replaced, F.col(f"n.{c}")).otherwise(F.col(f"old.{c}"))
    keep = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)
    table = both.select(
        "publisher_key", keep("name"), keep("url"), value("authority").alias("authority"),
        value("recognition").alias("recognition"), value("basis").alias("basis"), keep("first_seen"),
    )
    current = table.select("publisher_key", "authority", "recognition", "basis")
    return keyed.join(current, "publisher_key"), table


def official_domains(companies: DataFrame, sources: DataFrame) -> DataFrame:
    """(company, domain): root domains of sources whose company name contains the other's or the reverse.

    A name that contains another has it among its pieces, so both directions are joins by equality on distinct
    names, for lists of any length.
    """
    listed = sources.filter(F.coalesce("company", F.lit("")) != "").select(
        text.fold_case(F.col("company")).alias("listed"), urls.root_domain(urls.host(F.col("url"))).alias("domain")
    ).filter("domain != ''").distinct()
    named = companies.select("company").distinct().withColumn("name", text.fold_case(F.col("company"))).filter("name != ''")
    inside = named.select("company", F.explode(text.pieces_of(F.col("name"))).alias("listed")).join(listed, "listed")
    around = listed.select("domain", F.explode(text.pieces_of(F.col("listed"))).alias("name")).join(named, "name")
    return inside.select("company", "domain").unionByName(around.select("company", "domain")).distinct()


def looks_official(host: Column, company: Column, domains: Column, media: Column) -> Column:
    """Known domain of the company, else a distinct Latin brand in the host, else an official media label."""
    root = urls.root_domain(host)
    words = F.filter(
        F.regexp_extract_all(text.fold_case(company), F.lit(r"([a-z][a-z0-9]{3,})"), F.lit(1)),
        lambda w: ~w.isin(*fixed.GENERIC_BRAND_WORDS),
    )
    brand, label = text.title_key(company), text.title_key(F.coalesce(media, F.lit("")))
    labelled = (F.length(brand) >= 3) & label.contains(brand) & (label.contains("官网") | label.contains("official"))
    return ~urls.under_any(root, fixed.NON_OFFICIAL_HOSTS) & F.when(
        F.size(domains) > 0, F.array_contains(domains, root)
    ).otherwise(F.exists(words, lambda w: root.contains(w)) | labelled)


def product_pages(launches: DataFrame, found: DataFrame, pages: DataFrame, tries: int = 3) -> DataFrame:
    """First of at most ``tries`` official-looking results whose page headings carry the product name.

    launches: id, url, company, product, domains. found: id, position, link, media. pages: url, headings, text.
    """
    addressed = found.withColumn("link", urls.canonical(F.col("link"))).filter("link != ''")
    hosted = addressed.withColumn("link_host", urls.host(F.col("link"))).withColumn("link_path", urls.path(F.col("link")))
    rows = hosted.join(launches.withColumnRenamed("url", "item_url"), "id").filter(
        (F.col("link") != F.col("item_url"))
        & ~F.col("link_path").rlike(fixed.NON_PRODUCT_PATH)
        & looks_official(F.col("link_host"), F.col("company"), F.col("domains"), F.col("media"))
    )
    w = Window.partitionBy("id").orderBy("position")
    checked = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= tries)
    read = checked.join(pages.withColumnRenamed("url", "link"), "link")
    sure = looks_official(F.col("link_host"), F.col("company"), F.col("domains"), F.lit(""))
    product = text.title_key(F.col("product"))
    holds = (product != "") & text.title_key(F.col("headings")).contains(product) & (
        sure | text.title_key(F.col("text")).contains(text.title_key(F.col("company")))
    )
    return read.filter(holds).groupBy("id").agg(F.min_by("link", "n").alias("product_url"))
