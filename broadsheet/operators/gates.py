"""Row-level admission rules of the briefing job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import dates, scores, text, urls
from broadsheet.operators import matching


def category_hint(category: Column, title: Column, summary: Column, url: Column) -> Column:
    seen = F.concat(title, F.lit(" "), F.substring(summary, 1, 300))
    return (
        F.when((category == fixed.POLICY) | seen.rlike(fixed.POLICY_TITLE), F.lit(fixed.POLICY))
        .when((category == fixed.ACADEMIC) | url.contains("arxiv.org"), F.lit(fixed.ACADEMIC))
        .when(seen.rlike(fixed.CAPITAL_TITLE), F.lit(fixed.CAPITAL))
        .when(seen.rlike(fixed.RESEARCH_TITLE) & ~seen.rlike(fixed.RELEASE_TITLE), F.lit(fixed.ACADEMIC))
        .otherwise(F.lit(fixed.INDUSTRY))
    )


def prepare(items: DataFrame, rules: list[dict], excluded: list[str]) -> DataFrame:
    """Admission before any assessment; an item without a rule match stays, marked not accepted."""
    normal = text.normalize(F.concat_ws(" ", "title", "summary"))
    kept = items.filter(
        (F.col("url") != "") & ~urls.dictionary_site(F.col("url")) & ~matching.excluded_by(normal, excluded)
    )
    matched = matching.match_rules(kept, rules)
    return (
        matched.withColumn("accepted", F.size("matches") > 0)
        .withColumn("category", category_hint(F.col("category"), F.col("title"), F.col("summary"), F.col("url")))
        .withColumn("exploration", (F.size("matches") > 0) & F.forall("matches", lambda m: m["exploration"]))
        .withColumn("tags", matching.top_tags(F.col("matches")))
        .withColumn("score", F.coalesce(matching.top_weight(F.col("matches")), F.lit(0)).cast("double"))
    )


def alias_companies(seen: Column, aliases: dict[str, list[str]] = fixed.COMPANY_ALIASES) -> Column:
    """Folded names of known companies mentioned on a Latin word boundary."""
    import re

    hits = [
        F.when(
            seen.rlike("(?i)(?<![A-Za-z])(?:" + "|".join(re.escape(n) for n in names) + ")(?![A-Za-z])"),
            F.lit(company.lower()),
        )
        for company, names in aliases.items()
    ]
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def declared_companies(companies: Column, aliases: dict[str, list[str]] = fixed.COMPANY_ALIASES) -> Column:
    """Assessor-named companies under their canonical folded name."""
    known = {n.lower(): company.lower() for company, names in reversed(aliases.items()) for n in names}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(companies, lambda c: F.coalesce(F.try_element_at(table, F.lower(c)), text.fold_case(c)))


def company_keys(title: Column, source_summary: Column, companies: Column,
                 aliases: dict[str, list[str]] = fixed.COMPANY_ALIASES) -> Column:
    seen = F.concat_ws(" ", title, source_summary)
    return F.array_sort(
        F.array_distinct(F.concat(alias_companies(seen, aliases), declared_companies(companies, aliases)))
    )


def signal_tier(title: Column, summary: Column, body: Column, url: Column, exploration: Column) -> Column:
    """3 core evidence, 2 adjacent product or known company in an event, 1 exploratory use, 0 none."""
    seen = F.concat(title, F.lit(" "), F.substring(summary, 1, 2000), F.lit(" "), F.substring(body, 1, 1000))
    companies = alias_companies(F.concat_ws(" ", title, summary))
    folded = lambda names: F.array(*[F.lit(n) for n in names])
    plain = F.array_except(companies, folded(fixed.BROAD_COMPANIES + fixed.AMBIGUOUS_COMPANIES))
    host = urls.host(url)
    official = F.lit(False)
    for company, domains in fixed.AMBIGUOUS_DOMAINS.items():
        official = official | (F.array_contains(companies, company) & urls.under_any(host, domains))
    distinct_name = F.lit(False)
    for name in fixed.DISTINCT_COMPANY_NAMES:
        distinct_name = distinct_name | F.lower(title).contains(name)
    event = seen.rlike(fixed.EVENT_SIGNAL)
    return (
        F.when(seen.rlike(fixed.CORE_SIGNAL), F.lit(3))
        .when(seen.rlike(fixed.AUDIO_SIGNAL) & seen.rlike(fixed.TARGET_APPLICATION_SIGNAL), F.lit(2))
        .when(seen.rlike(fixed.GLASSES_SIGNAL) & (seen.rlike(fixed.APPLICATION_SIGNAL) | event), F.lit(2))
        .when(seen.rlike(fixed.WEARABLE_SIGNAL) & seen.rlike(fixed.BIOSIGNAL), F.lit(2))
        .when((F.size(plain) > 0) & event, F.lit(2))
        .when(
            F.arrays_overlap(companies, folded(fixed.AMBIGUOUS_COMPANIES)) & event & (official | distinct_name),
            F.lit(2),
        )
        .when(exploration & seen.rlike(fixed.EXPLORE_FORM) & seen.rlike(fixed.EXPLORE_USE), F.lit(1))
        .otherwise(F.lit(0))
    )


def fresh_collection(items: DataFrame, today: Column, days: Column, strict: bool = False) -> DataFrame:
    """Drop what is known to be old; undated rows wait for a date.

    With ``strict`` the event's day, else its first report, counts before the publication day. Where items carry
    first_submitted and last_revised, papers need the proof of their version date.
    """
    counted = dates.news_day(F.col("event_day"), F.col("first_reported"), F.col("published")) if strict else F.col("published")
    kept = F.col("published").isNull() | dates.in_window(today, counted, days)
    if {"first_submitted", "last_revised"} <= set(items.columns):
        kept = kept & proven_paper_date(F.col("url"), F.col("published"), F.col("first_submitted"), F.col("last_revised"))
    return items.filter(kept)


def proven_paper_date(url: Column, published: Column, first: Column, revised: Column) -> Column:
    proof = F.coalesce((first <= revised) & (published == revised), F.lit(False))
    return ~urls.host(url).isin(*fixed.PAPER_HOSTS) | proof


def jurisdiction_evidence(url: Column, title: Column, summary: Column, body: Column, source: Column) -> Column:
    seen = F.concat_ws(" ", title, summary, F.substring(body, 1, 700), source)
    return (
        urls.government(urls.host(url)) | seen.rlike(fixed.NATIONAL_EVIDENCE) | seen.rlike(fixed.LOCAL_EVIDENCE)
    )


def apply_assessment(items: DataFrame, priority: Column | None = None) -> DataFrame:
    """Gate items already joined with their assessment (columns a_*); no assessment means rejected.

    ``priority`` is an item's highest rule weight (0 without a rule); with it, ``score`` is set to its blend with the
    assessed relevance.
    """
    if priority is not None:
        items = items.withColumn("score", scores.business_score(priority, F.col("a_relevance")))
    c = F.col
    evidence = F.concat(
        c("title"), F.lit(" "), F.substring(F.when(c("summary") != "", c("summary")).otherwise(c("body")), 1, 700)
    )
    named_kind = F.coalesce(c("a_source_kind"), F.when(c("a_relevance").isNotNull(), F.lit("secondary")))
    kind = F.when(named_kind.isin(*fixed.SOURCE_KINDS), named_kind).otherwise(F.lit("unknown"))
    effective = scores.effective_relevance(
        c("a_relevance"), c("a_category"), F.concat_ws(" ", c("title"), c("summary"), F.substring(c("body"), 1, 1000))
    )
    undated = F.coalesce(c("date_evidence") == "recent_first_seen", F.lit(False))
    policy_ok = (c("a_category") != fixed.POLICY) | jurisdiction_evidence(
        c("url"), c("title"), c("summary"), c("body"), c("source")
    )
    named = F.filter(
        c("a_companies"),
        lambda n: (F.length(F.trim(n)) >= 2)
        & ~n.isin(*fixed.GENERIC_COMPANIES)
        & text.fold_case(evidence).contains(text.fold_case(n)),
    )
    subject = F.trim(c("a_subject"))
    return (
        items.withColumn("source_kind", kind)
        .withColumn("effective", effective)
        .withColumn(
            "accepted",
            F.coalesce(
                c("a_accept")
                & (effective >= fixed.ACCEPT_THRESHOLD)
                & (~undated | c("a_category").isin(*fixed.UNDATED_CATEGORIES))
                & policy_ok
                & (kind != "unknown"),
                F.lit(False),
            ),
        )
        .withColumn("companies", F.slice(named, 1, 3))
        .withColumn(
            "subject",
            F.when(F.length(subject).between(2, 80) & evidence.contains(subject), subject).otherwise(F.lit("")),
        )
        .withColumn("relevance", c("a_relevance"))
        .withColumn("category", F.coalesce(c("a_category"), c("category")))
        .withColumn(
            "tags",
            F.transform(
                F.slice(c("a_tags"), 1, 3),
                lambda t: F.substring(F.regexp_replace(t, r"[\[\]<>\n]", ""), 1, 18),
            ),
        )
    )


def assessment_issues(rows: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Validate assessor rows held as JSON: (batch, id, issue), issue NULL for a usable row.

    rows: id string, payload string. An id given twice is unusable altogether. Counting per id is a plain
    aggregation, so a batch that repeats one id for a third of its rows is combined before the shuffle.
    """
    raw = lambda field: F.get_json_object("payload", f"$.{field}")
    number = raw("relevance")
    integer = F.when(number.rlike(r"^-?\d+$"), number.try_cast("int"))
    quoted = F.col("payload").rlike(r'"relevance"\s*:\s*"')
    flag = F.col("payload").rlike(r'"accept"\s*:\s*(true|false)')
    tags = F.from_json(raw("tags"), "array<string>")
    text_tags = ~F.col("payload").rlike(r'"tags"\s*:\s*\[[^\]]*?(?<=[\[,\s])(?:-?\d|true|false|null|\{|\[)')
    per_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.first("payload").alias("payload"))
    checked = per_id.join(known_ids.select("id", F.lit(True).alias("known")), "id", "full_outer")
    issue = (
        F.when(F.col("known").isNull(), F.lit("unknown_id"))
        .when(F.col("times").isNull(), F.lit("missing"))
        .when(F.col("times") > 1, F.lit("duplicate_id"))
        .when(quoted | integer.isNull() | ~integer.between(0, 100) | ~flag, F.lit("invalid_score"))
        .when(~F.coalesce(raw("category"), F.lit("")).isin(*fixed.CATEGORIES), F.lit("invalid_category"))
        .when(tags.isNull() | ~text_tags, F.lit("invalid_tags"))
    )
    return checked.select("id", issue.alias("issue"))


def review_issues(reviews: DataFrame) -> DataFrame:
    """Event reviews joined with their article (title, body, page_day): add ``issue`` or keep it NULL."""
    c = F.col
    whole = F.concat(c("title"), c("body"))
    dated = c("event_day").isNotNull()
    proven = (c("date_quote") != "") & c("body").contains(c("date_quote")) & dates.quote_supports(
        c("event_day"), c("date_quote"), c("page_day")
    )
    issue = (
        F.when(c("relevant").isNull() | c("single_event").isNull(), F.lit("event_review_invalid"))
        .when(dated & ~proven, F.lit("event_date_unsubstantiated"))
        .when(
            (c("focus_quote") != "") & ((F.length("focus_quote") > 350) | ~c("body").contains(c("focus_quote"))),
            F.lit("roundup_focus_unsubstantiated"),
        )
        .when(
            (c("subject") != "") & ((F.length("subject") > 80) | ~whole.contains(c("subject"))),
            F.lit("event_subject_unsubstantiated"),
        )
        .when((c("category") != "") & ~c("category").isin(*fixed.CATEGORIES), F.lit("event_category_invalid"))
        .when(
            (F.size("tags") > 3) | F.exists("tags", lambda t: F.length(t) > 18), F.lit("event_tags_invalid")
        )
        .when(~(c("relevant") & c("single_event")), F.lit("no_single_relevant_event"))
        .when(
            c("title").rlike(fixed.ROUNDUP_TITLE) & (~dated | (c("focus_quote") == "")),
            F.lit("roundup_event_not_located"),
        )
    )
    supported = F.filter("tags", lambda t: (t != "") & whole.contains(t))
    return reviews.withColumn("issue", issue).withColumn("supported_tags", supported)


def channel_score_issue(relevance: Column, novelty: Column, summary: Column, reason: Column,
                        chinese: bool = True) -> Column:
    """Why a channel assessment cannot be used; inputs are raw JSON values as text."""
    whole = lambda v: v.rlike(r"^(?:[0-9]|10)(?:\.0+)?$")
    speaks = lambda v: F.lit(True) if not chinese else v.rlike(r"[一-鿿]")
    return (
        F.when(~F.coalesce(whole(relevance) & whole(novelty), F.lit(False)), F.lit("score"))
        .when((F.trim(F.coalesce(summary, F.lit(""))) == "") | (F.trim(F.coalesce(reason, F.lit(""))) == ""), F.lit("empty"))
        .when(~(speaks(summary) & speaks(reason)), F.lit("language"))
    )


def fallback_assessment(rule_score: Column, matched: Column, summary: Column, content: Column, title: Column,
                        english: bool = False) -> dict[str, Column]:
    """Deterministic channel assessment for items nobody assessed."""
    lead = F.array_join(F.slice(matched, 1, 3), ", " if english else "、")
    if english:
        reason = F.when(lead != "", F.concat(F.lit("Matched interests: "), lead, F.lit("."))).otherwise(
            F.lit("Selected by local relevance rules.")
        )
    else:
        reason = F.when(lead != "", F.concat(F.lit("命中关注词："), lead, F.lit("。"))).otherwise(
            F.lit("根据规则排序入选。")
        )
    body = F.when(summary != "", summary).when(content != "", content).otherwise(title)
    return {
        "relevance_score": F.greatest(F.lit(0), F.least(F.lit(10), F.bround(rule_score / 10, 0))).cast("int"),
        "novelty_score": F.lit(0),
        "reason": reason,
        "digest": text.truncate(body, 200),
    }


def launch_candidate(summary: Column) -> Column:
    return summary.rlike(fixed.RELEASE_WORDS)


def confirmed_launch(is_launch: Column, product: Column, company: Column, known_company: Column,
                     evidence: Column) -> Column:
    """Product launch whose name and company are both borne out by the source text."""
    seen, name = text.title_key(evidence), F.trim(product)
    product_key, company_key = text.title_key(name), text.title_key(F.trim(company))
    known_key = text.title_key(F.trim(known_company))
    named = (
        F.length(name).between(2, 80)
        & ~product_key.isin(*fixed.GENERIC_PRODUCTS)
        & seen.contains(product_key)
    )
    in_evidence = (F.trim(company) != "") & seen.contains(company_key)
    conflict = (
        (F.trim(known_company) != "") & in_evidence
        & ~known_key.contains(company_key) & ~company_key.contains(known_key)
    )
    return F.coalesce(is_launch & named & ~conflict & ((F.trim(known_company) != "") | in_evidence), F.lit(False))


def repository_category(seen: Column, english: bool = False) -> Column:
    out = F.lit(fixed.REPO_OTHER[1 if english else 0])
    for chinese, name, words, _, _ in reversed(fixed.REPO_CATEGORIES):
        hit = F.lit(False)
        for word in words:
            hit = hit | seen.contains(word)
        out = F.when(hit, F.lit(name if english else chinese)).otherwise(out)
    return out


def repository_use_case(category: Column, english: bool = False) -> Column:
    out = F.lit(fixed.REPO_OTHER[3 if english else 2])
    for chinese, _, _, use, english_use in fixed.REPO_CATEGORIES:
        out = F.when(category == chinese, F.lit(english_use if english else use)).otherwise(out)
    return out


def first_seen_proxy(items: DataFrame, trusted: DataFrame) -> DataFrame:
    """Undated items of trusted listings stand on their discovery day once their page was read in vain.

    items: id, published, first_reported, date_evidence (after reading), listed_evidence (before). trusted: id, first_seen.
    """
    joined = items.join(trusted.select("id", "first_seen"), "id", "left")
    stands = (
        F.col("published").isNull()
        & F.col("first_seen").isNotNull()
        & (F.col("listed_evidence") == "no_date_hint")
        & (F.col("date_evidence") == "no_date_hint")
    )
    seen = F.col("first_seen")
    return (
        joined.withColumn("stands", stands)
        .withColumn("published", F.when(F.col("stands"), seen).otherwise(F.col("published")))
        .withColumn("first_reported", F.when(F.col("stands"), seen).otherwise(F.col("first_reported")))
        .withColumn("date_evidence", F.when(F.col("stands"), F.lit("recent_first_seen")).otherwise(F.col("date_evidence")))
        .drop("stands", "first_seen", "listed_evidence")
    )


def summary_evidence(items: DataFrame, rules: list[dict], lead: int = 4, limit: int | None = 6000) -> DataFrame:
    """Add ``evidence``: a usable source summary, else the first paragraphs and later ones that match one of the item's own rules.

    items: title, summary, body, rule_ids (the rules that the item as a whole matches).
    """
    paragraphs = F.array_join(matching.paragraph_matches(F.col("body"), rules, lead, F.col("rule_ids")), "\n")
    evidence = F.when(text.usable_summary(F.col("summary"), F.col("title")), F.col("summary")).otherwise(paragraphs)
    return items.withColumn("evidence", evidence if limit is None else F.substring(evidence, 1, limit))


def evidence_signature(*parts: Column) -> Column:
    """Cache key of a decision: any change of its inputs changes it."""
    return text.digest(F.concat(*parts))


def candidate_union(collected: DataFrame, candidates: DataFrame, recent: DataFrame) -> DataFrame:
    """The day's candidates in provenance order; ``pos`` ranks collected, then retained, then recent rows."""
    parts = [t.withColumn("provenance", F.lit(i)) for i, t in enumerate((collected, candidates, recent))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
