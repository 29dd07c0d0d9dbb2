"""Crawled pages and sites: links, visible text, key pages, broken and repeated pages, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions.text import collapse, joined, matches_any, names_matching, phrases_in, some, strip, text
from ..functions.urls import absolute, url_domain, without_fragment


def links(html: Column | str, page: Column) -> Column:
    """A page's links in their order, made absolute."""
    return F.transform(F.regexp_extract_all(text(html), F.lit(r'href="([^"]*)"'), F.lit(1)), lambda x: absolute(x, page))


def visible_text(html: Column | str) -> Column:
    """Text without scripts, styles, comments and tags; the common entities are resolved; white space is collapsed."""
    out = F.regexp_replace(text(html), r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def real_subpages(found: Column, homepage: Column) -> Column:
    home = without_fragment(homepage)
    return F.filter(found, lambda x: without_fragment(x) != home)


def same_domain(found: Column, homepage: Column) -> Column:
    home = url_domain(homepage)
    return F.filter(found, lambda x: (url_domain(x) != "") & (url_domain(x) == home))


def key_pages(sites: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Columns homepage, about, pricing, careers and product for rows (id, homepage, links): the first link on the site that has a
    category's word; else the first usual path that is among ``known_urls`` (url); for product at last the first link that is left."""
    df = sites.withColumn("site_links", same_domain(real_subpages(F.col("links"), F.col("homepage")), F.col("homepage")))
    for category, words in V.PAGE_KEYWORDS.items():
        df = df.withColumn(category, F.get(_with_words(F.col("site_links"), words), F.lit(0)))
    base = F.regexp_replace("homepage", "/+$", "")
    tried = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(i).alias("rank"), F.concat(base, F.lit(p)).alias("url")) for c, ps in V.PAGE_PATHS.items() for i, p in enumerate(ps)))
    wanted = df.select("id", *V.PAGE_PATHS, F.explode(tried).alias("t")).select("id", "t.*", *V.PAGE_PATHS)
    missing = F.lit(False)
    for c in V.PAGE_PATHS:
        missing |= (F.col("category") == c) & F.col(c).isNull()
    there = wanted.where(missing).join(known_urls.select("url").distinct(), "url")
    firsts = there.groupBy("id").pivot("category", list(V.PAGE_PATHS)).agg(F.min_by("url", "rank"))
    df = df.join(firsts.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in V.PAGE_PATHS)), F.col("id") == F.col("__id"), "left")
    df = df.withColumns({c: F.coalesce(c, f"__{c}") for c in V.PAGE_PATHS})
    assigned = F.array_compact(F.array("homepage", "about", "pricing", "careers"))
    rest = F.get(F.filter("site_links", lambda x: ~F.array_contains(assigned, x)), F.lit(0))
    return df.withColumn("product", F.coalesce("product", rest)).select("id", "homepage", *V.PAGE_PATHS)


def _with_words(found: Column, words: tuple[str, ...]) -> Column:
    return F.filter(found, lambda x: F.lower(x).rlike("|".join(words)))


def is_broken(content: Column | str) -> Column:
    """Almost empty, or with a mark of an error page."""
    bare = strip(content)
    low = F.lower(bare)
    marked = F.exists(F.array(*map(F.lit, V.BROKEN_MARKERS)), lambda m: F.contains(low, m))
    return (F.length(bare) < V.MIN_CONTENT_CHARS) | marked | matches_any(low, V.BROKEN_PATTERNS, "(?Uiud)")


def fingerprint(content: Column | str) -> Column:
    """SHA-256 of the text without images and addresses, folded and with collapsed white space."""
    bare = F.regexp_replace(text(content), r"(?d)!\[.*?\]\(.*?\)", "")
    bare = F.regexp_replace(bare, r"(?U)https?://\S+", "")
    bare = F.replace(bare, F.lit("<Base64-Image-Removed>"), F.lit(""))
    return F.sha2(F.lower(collapse(bare)), 256)


def truncated(content: Column | str, n: int = V.MAX_PAGE_CHARS) -> Column:
    return F.substring(text(content), 1, n)


def distinct_contents(pages: DataFrame, site: str = "site", order: str = "id") -> DataFrame:
    """Of a site's pages with one fingerprint, the first in order (the homepage's fingerprint is of its whole text, the others' of the truncated one)."""
    mark = F.when(F.col("source") == "homepage", fingerprint("content")).otherwise(fingerprint(truncated("content")))
    # texts stay out of the shuffle: only their digests are compared
    ranked = Window.partitionBy(site, "fingerprint").orderBy(F.when(F.col("source") == "homepage", 0).otherwise(1), order)
    return pages.select(site, order, "source", "url", mark.alias("fingerprint")).withColumn("n", F.row_number().over(ranked)).where("n = 1").drop("n")


def careers_signal(content: Column | str) -> Column:
    """struct(has_content, engineering, other, hiring_technical, ratio) of a careers page."""
    low = F.lower(text(content))
    full = strip(low) != ""
    eng, other = F.array_sort(phrases_in(low, V.ENGINEERING_ROLES)), F.array_sort(phrases_in(low, V.OTHER_ROLES))
    total = F.size(eng) + F.size(other)
    none = F.lit(None)
    return F.struct(
        full.alias("has_content"),
        F.when(full, eng).alias("engineering"),
        F.when(full, other).alias("other"),
        F.when(full, F.size(eng) > 0).alias("hiring_technical"),
        F.when(full & (total > 0), F.bround(F.size(eng) / total, 2)).otherwise(none.cast("double")).alias("ratio"),
    )


def pricing_signal(content: Column | str) -> Column:
    """struct(has_content, self_serve, sales_led, visible_price, motion) of a pricing page."""
    low = F.lower(text(content))
    full = strip(low) != ""
    own, sales = F.array_sort(phrases_in(low, V.SELF_SERVE_MARKERS)), F.array_sort(phrases_in(low, V.SALES_LED_MARKERS))
    motion = F.when((F.size(own) > 0) & (F.size(sales) > 0), "mixed").when(F.size(own) > 0, "self_serve").when(F.size(sales) > 0, "sales_led").otherwise("unclear")
    return F.struct(
        full.alias("has_content"),
        F.when(full, own).alias("self_serve"),
        F.when(full, sales).alias("sales_led"),
        F.when(full, matches_any(low, [V.VISIBLE_PRICE], "(?Uiu)")).alias("visible_price"),
        F.when(full, motion).alias("motion"),
    )


def _listed(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _truth(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def _as_text(heading: str, has: str, s: Column, lines: list[tuple[str, Column]]) -> Column:
    rest = [F.when(s["has_content"], F.concat(F.lit(f"- {name}: "), value)) for name, value in lines]
    return F.concat_ws("\n", F.lit(f"[{heading} — deterministic extraction, no raw text]"), F.concat(F.lit(f"- {has}: "), _truth(s["has_content"])), *rest)


def careers_text(s: Column) -> Column:
    ratio = F.coalesce(s["ratio"].cast("string"), F.lit("None"))
    return _as_text("Careers signal", "has_careers_page_content", s, [("engineering_keywords_found", _listed(s["engineering"])), ("other_keywords_found", _listed(s["other"])), ("hiring_technical", _truth(s["hiring_technical"])), ("engineering_ratio", ratio)])


def pricing_text(s: Column) -> Column:
    return _as_text("Pricing signal", "has_pricing_page_content", s, [("self_serve_markers_found", _listed(s["self_serve"])), ("sales_led_markers_found", _listed(s["sales_led"])), ("has_visible_price", _truth(s["visible_price"])), ("pricing_motion", s["motion"])])


def page_signals(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The rows without the html, with all signals of one page: generator_meta_tag, generator_fingerprint, build_tool_phrases, trend_fonts, visual_patterns,
    style_phrases, style_density, disclosures, repo_url. The html is read once and isn't shuffled."""
    rest = [c for c in pages.columns if c != html]
    df = pages.select(*rest, text(html).alias("__html"), F.lower(text(html)).alias("__low"), F.lower(visible_text(html)).alias("__text"), links(html, F.col(url)).alias("__links"))
    meta = F.regexp_extract("__html", r"""(?iu)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']""", 1)
    builder = F.coalesce(*(F.when(matches_any(F.col("__html"), ps), F.lit(name)) for name, ps in V.BUILDERS.items()))
    df = df.select(
        *rest,
        some(meta).alias("generator_meta_tag"),
        builder.alias("generator_fingerprint"),
        phrases_in(F.col("__low"), V.BUILD_TOOL_PHRASES).alias("build_tool_phrases"),
        F.filter(F.array(*map(F.lit, V.TREND_FONTS)), lambda f: F.contains(F.col("__low"), F.lower(f))).alias("trend_fonts"),
        names_matching(F.col("__html"), V.VISUAL_PATTERNS).alias("visual_patterns"),
        phrases_in(F.col("__text"), V.STYLE_PHRASES).alias("style_phrases"),
        phrases_in(F.col("__text"), V.DISCLOSURES).alias("disclosures"),
        repo_link(F.col("__links")).alias("repo_url"),
    )
    return df.withColumn("style_density", style_density(F.size("style_phrases")))


def style_density(n: Column) -> Column:
    return F.when(n >= 4, "high").when(n >= 2, "medium").when(n == 1, "low").otherwise("none")


def repo_link(found: Column) -> Column:
    """The first link to a code host that isn't an issue or a pull request."""
    return F.get(F.filter(found, lambda x: F.contains(F.lower(x), F.lit("github.com")) & ~F.contains(x, F.lit("/issues")) & ~F.contains(x, F.lit("/pull"))), F.lit(0))


def repo_parts(url: Column | str) -> Column:
    """struct(owner, repo, error)."""
    url = F.col(url) if isinstance(url, str) else url
    pattern = r"github\.com/([^/]+)/([^/?#]+)"
    good = url.rlike(pattern)
    return F.struct(F.when(good, F.regexp_extract(url, pattern, 1)).alias("owner"), F.when(good, F.regexp_extract(url, pattern, 2)).alias("repo"), F.when(url.isNotNull() & ~good, "Unrecognized GitHub URL").alias("error"))


def commit_facts(commits: DataFrame, newest: int = 100) -> DataFrame:
    """Per repo_url of (repo_url, ts, message), over its newest commits: total_commits_seen, first_commit_message (the oldest of them), single_commit_repo."""
    recent = Window.partitionBy("repo_url").orderBy(F.desc("ts"), F.desc("message"))
    seen = commits.withColumn("n", F.row_number().over(recent)).where(F.col("n") <= newest)
    return seen.groupBy("repo_url").agg(F.count(F.lit(1)).alias("total_commits_seen"), F.max_by("message", "n").alias("first_commit_message"), (F.count(F.lit(1)) <= 1).alias("single_commit_repo"))


def signal_tier(df: DataFrame) -> DataFrame:
    """Adds tier: STRONG, MEDIUM, WEAK or none, from the columns of page_signals."""
    strong = F.col("generator_fingerprint").isNotNull() | (F.size("disclosures") > 0)
    medium = (F.size("build_tool_phrases") > 0) | (F.col("style_density") == "high")
    return df.withColumn("tier", F.when(strong, "STRONG").when(medium, "MEDIUM").when(F.size("visual_patterns") > 0, "WEAK").otherwise("none"))


def _judged(pages: DataFrame, lead: str) -> DataFrame:
    """lead, id, home, broken and kept of pages (lead, id, source, content); texts stay out of the shuffle. A homepage is judged by its whole text, other
    pages by what is stored of them. Kept are usable pages that repeat no earlier usable one; a broken page hides none."""
    home = F.col("source") == "homepage"
    stored = F.when(home, text("content")).otherwise(truncated("content"))
    rows = pages.select(lead, "id", home.alias("home"), stored.alias("stored")).select(lead, "id", "home", is_broken("stored").alias("broken"), fingerprint("stored").alias("mark"))
    ranked = Window.partitionBy(lead, "broken", "mark").orderBy(F.desc("home"), "id")
    return rows.withColumn("kept", ~F.col("broken") & (F.row_number().over(ranked) == 1))


def fetch_status(pages: DataFrame, lead: str = "site") -> DataFrame:
    """Per lead of (lead, id, source, content): n_pages, n_kept, n_unusable, status, last_error. A lead whose
    homepage is broken keeps nothing, and that is its error; one of which only the homepage is usable among several counts as failed."""
    rows = _judged(pages, lead)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    per = rows.groupBy(lead).agg(F.count(F.lit(1)).alias("n_pages"), n(F.col("kept")).alias("n_kept"), n(F.col("home") & ~F.col("broken")).alias("homes"))
    failed = F.col("homes") == 0
    kept = F.when(failed, 0).otherwise(F.col("n_kept")).cast("long")
    per = per.withColumn("n_unusable", F.col("n_pages") - kept)
    status = F.when(failed, "FETCH_FAILED").when((kept == 1) & (F.col("n_pages") > 1), "FETCH_FAILED").when(F.col("n_unusable") > 0, "FETCH_PARTIAL").otherwise("PARSED")
    return per.select(lead, "n_pages", kept.alias("n_kept"), "n_unusable", status.alias("status"), F.when(failed, V.HOMEPAGE_ERROR).alias("last_error"))


def kept_pages(pages: DataFrame, lead: str = "site", home_chars: int | None = V.MAX_PAGE_CHARS) -> DataFrame:
    """The rows that are stored of a lead's pages: lead, id, source, url, content (cut, homepages at ``home_chars`` or, if that is None, not at all; careers and
    pricing pages as the text of their signals). None of a lead whose homepage is broken."""
    rows = _judged(pages, lead)
    usable = F.max(F.when(F.col("home") & ~F.col("broken"), 1)).over(Window.partitionBy(lead))
    ids = rows.withColumn("usable", usable).where("kept AND usable = 1").select("id")
    stored = truncated("content")
    home = text("content") if home_chars is None else truncated("content", home_chars)
    content = F.when(F.col("source") == "homepage", home).when(F.col("source") == "careers", careers_text(careers_signal(stored))).when(F.col("source") == "pricing", pricing_text(pricing_signal(stored))).otherwise(stored)
    return pages.select(lead, "id", "source", "url", content.alias("content")).join(ids, "id", "left_semi").select(lead, "id", "source", "url", "content")


def pages_by_source(pages: DataFrame, lead: str = "site", content: str = "content") -> DataFrame:
    """A column for each source; of several pages of a source the last counts."""
    return pages.groupBy(lead).pivot("source", list(V.SOURCES)).agg(F.max_by(content, "id"))


def strip_images(c: Column | str) -> Column:
    """Text without image and media marks."""
    suffix = r"\.(?:png|jpe?g|gif|svg|webp|bmp|ico)"
    out = text(c)
    for pattern in (
        r"(?d)!\[.*?\]\(.*?\)",
        r"(?dU)!\[.*?\]\s*\[.*?\]",
        r"<(img|figure|picture|video|source|svg|canvas)[^>]*>",
        r"</(img|figure|picture|video|source|svg|canvas)>",
        r"(?s)<style[^>]*>.*?</style>",
        rf"(?iuU)https?://\S+{suffix}(?:\?\S*)?",
        rf"(?diuU)\[.*?\]\(\s*[^)]+{suffix}\s*\)",
        rf"(?iuU)\b\w+{suffix}(?:\?\S*)?",
    ):
        out = F.regexp_replace(out, pattern, "")
    return out


def preview(c: Column | str, n: int = 400) -> Column:
    flat = collapse(c)
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, n), r"(?U)\s+$", ""), F.lit(" …"))
    return F.when(text(c) == "", "(page not found / not scraped)").when(F.length(flat) <= n, flat).otherwise(cut)


def signals_summary(found: Column | None = None) -> Column:
    """One sentence from the columns of page_signals; ``found``: whether there is a row of signals."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    phrases = F.when(
        F.size("style_phrases") > 0,
        F.concat(F.lit("Generic marketing phrases (density "), F.col("style_density"), F.lit("): "), F.array_join(F.slice("style_phrases", 1, 5), ", "), F.when(F.size("style_phrases") > 5, ", ...").otherwise("")),
    )
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("AI generator detected: "), some("generator_fingerprint")),
        F.concat(F.lit("<meta generator> tag: "), some("generator_meta_tag")),
        F.concat(F.lit("Trend fonts: "), listed("trend_fonts")),
        F.concat(F.lit("Visual patterns ("), F.size("visual_patterns").cast("string"), F.lit("/9): "), listed("visual_patterns")),
        F.concat(F.lit('Explicit "vibe-coding" language: '), listed("build_tool_phrases")),
        phrases,
        F.concat(F.lit("Explicit mention of AI-generated content: "), listed("disclosures")),
        F.concat(F.lit("Public GitHub repo: "), some("repo_url")),
    )
    out = F.when(parts == "", "No deterministic technical signals detected.").otherwise(parts)
    return out if found is None else F.when(found, out).otherwise("No technical signals computed.")


def repo_summary(check: Column) -> Column:
    """Of a checked repository: struct(checked, evidence(total_commits_seen, first_commit_message, single_commit_repo))."""
    e = check["evidence"]
    first = F.when(F.coalesce(e["first_commit_message"], F.lit("")) != "", F.concat(F.lit('first commit: "'), F.substring(e["first_commit_message"], 1, 60), F.lit('"')))
    parts = F.concat_ws(" | ", F.concat(F.coalesce(e["total_commits_seen"].cast("string"), F.lit("?")), F.lit(" commits seen (API page)")), F.when(e["single_commit_repo"], "⚠️ single-commit repo"), first)
    return F.when(F.coalesce(check["checked"], F.lit(False)), parts).otherwise("")


def listed_signals(df: DataFrame) -> DataFrame:
    """Signal lists written as report cells."""
    return df.withColumns({c: joined(c) for c in ("build_tool_phrases", "trend_fonts", "visual_patterns", "style_phrases", "disclosures")})
