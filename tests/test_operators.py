import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import components, dedup, event_log, evidence, ingest, leads, pages, reports, state, verdicts
from leadloom.sources import scratch, tables
from leadloom.streaming import flows


def one(df):
    return df.first()[0]


def test_header_aliases_and_byte_order_mark(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('﻿ Company ,Website URL,Email Address,first name,Job Title,Extra\n"Acme ""Q"", Inc",https://www.Acme.io/x, A@Acme.io ,Ann,"multi\nline",1\nNone,,b@x.io,Bob,,2\n', encoding="utf-8")
    got = tables.import_contacts(spark, str(path), 5, "b1", at="2024-01-02 03:04:05").collect()
    assert len(got) == 1
    row = got[0]
    assert (row.id, row.session_id, row.company_name, row.domain_normalized, row.email, row.email_domain) == (1, 5, 'Acme "Q", Inc', "acme.io", "A@Acme.io", "acme.io")
    assert row.title == "multi\nline" and row.status == "NEW" and row.last_name == "" and row.domain_mismatch == 0


def test_first_alias_with_raw_value_wins_and_last_header_counts(spark):
    df = spark.createDataFrame([("  ", "later", "a", "b")], ["company", "organization", "Email", "email "])
    row = ingest.pick_columns(df).first()
    assert row.company_name == "" and row.email == "b" and row.website_url == ""


def test_unicode_space_is_stripped(spark):
    df = spark.createDataFrame([(" https://WWW.x.de/a ", "u@Mail.X.de")], ["website_url", "email"])
    row = ingest.normalize(df).first()
    assert (row.domain_normalized, row.email_domain, row.domain_mismatch) == ("x.de", "mail.x.de", 0)


def sequential(rows, threshold):
    """The definition: one lead after the other against the originals so far."""
    out, originals = [], []
    for id_, email, domain, name in rows:
        key = " ".join(sorted(name.strip().lower().split()))
        hit = next(((o[0], "exact_email") for o in originals if email and o[1] == email), None) or next(((o[0], "domain_match") for o in originals if domain and o[2] == domain), None)
        if not hit and key:
            hit = next(((o[0], "fuzzy_company_name") for o in originals if o[3] and 200 * dedup.common_subsequence(key, o[3]) >= threshold * (len(key) + len(o[3]))), None)
        out.append((id_, 1 if hit else 0, *(hit or (None, None))))
        if not hit:
            originals.append((id_, email, domain, key))
    return out


@pytest.mark.parametrize("threshold, rounds, pack", [(90, 3, 1_000_000), (70, 3, 1_000_000), (90, 0, 60), (90, 1, 8), (70, 1, 30)])
def test_resolution_equals_the_sequential_scan(spark, threshold, rounds, pack):
    rng = random.Random(threshold)
    words = ["acme", "acmee", "labs", "lab", "studio", "north", "nort", "x"]
    rows = [(i, rng.choice(["", f"u{rng.randint(0, 30)}@x.io"]), rng.choice(["", f"d{rng.randint(0, 40)}.io"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, email string, domain_normalized string, company_name string")
    got = sorted(tuple(r) for r in dedup.resolve(df, threshold, rounds=rounds, pack=pack).collect())
    assert got == sequential(rows, threshold)


@pytest.mark.parametrize("few, threshold", [(0, 90), (1, 90), (4, 90), (4, 70)])
def test_resolution_by_first_leads_equals_the_sequential_scan(spark, few, threshold):
    rng = random.Random(few)
    words = ["acme", "acmee", "labs", "lab", "studio", "north", "nort", "x"]
    rows = [(i, rng.choice(["", f"u{rng.randint(0, 60)}@x.io"]), f"d{int(6 * rng.random() ** 3)}.io" if i % 9 else "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, email string, domain_normalized string, company_name string")
    got = sorted(tuple(r) for r in dedup.resolve(df, threshold, few=few).collect())
    assert got == sequential(rows, threshold)


def test_leads_of_few_domains_need_few_comparisons(spark, monkeypatch):
    monkeypatch.setattr(dedup, "similar_names", lambda *_, **__: pytest.fail("all names are compared"))
    r = random.Random(3)
    part = lambda: r.choice("th er an on re he in ed nd ti".split())
    rows = [(i, "", f"d{i % 40}.io", "".join(part() for _ in range(30))) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, email string, domain_normalized string, company_name string")
    assert sorted(tuple(x) for x in dedup.resolve(df).collect()) == [(i, 0, None, None) if i < 40 else (i, 1, i % 40, "domain_match") for i in range(9000)]


def test_long_chains_are_finished_as_components(spark):
    # in each chain a lead has the e-mail of the one before or the domain of the one after, so all wait for the first
    n = 5000
    rows = [(i, f"m{(i + 1) // 2}@x.io", f"d{i // 2}.io", "") for i in range(n)] + [(n + i, f"n{(i + 1) // 2}@x.io", f"e{i // 2}.io", "") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, email string, domain_normalized string, company_name string")
    first_mail, first_domain, want = {}, {}, []
    for i, mail, domain, _ in rows:
        hit = (first_mail[mail], "exact_email") if mail in first_mail else (first_domain[domain], "domain_match") if domain in first_domain else None
        want.append((i, 1 if hit else 0, *(hit or (None, None))))
        if not hit:
            first_mail[mail] = first_domain[domain] = i
    jobs = spark.sparkContext.statusTracker()
    for rounds, pack in ((3, 1_000_000), (2, 12_000)):
        spark.sparkContext.setJobGroup(f"chain-{pack}", "")
        assert sorted(tuple(r) for r in dedup.resolve(df, None, rounds=rounds, pack=pack).collect()) == want
        made = len(jobs.getJobIdsForGroup(f"chain-{pack}"))
        assert pack < 1_000_000 or made < 15
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_keys(spark):
    posts = [(1, "a"), (2, "a"), (2, "b"), (5, "b"), (3, "c"), (4, "d"), (4, "e"), (9, "e"), (7, "e")] + [(i, f"k{j}") for i in range(100, 180) for j in (i, i + 1)]
    df = spark.createDataFrame([(i, 0, k) for i, k in posts], "id long, kind int, key string")
    got = {r.id: r.root for r in components.key_components(df).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 3: 3, 4: 4, 9: 4, 7: 4} | {i: 100 for i in range(100, 180)}
    assert components.key_components(df.limit(0)).collect() == []


def test_flagged_leads_neither_match_nor_change(spark):
    df = spark.createDataFrame([(1, "a@x", "", "", 1), (2, "a@x", "", "", 0), (3, "a@x", "", "", 0)], "id long, email string, domain_normalized string, company_name string, is_duplicate int")
    assert sorted((r.id, r.is_duplicate, r.duplicate_of_id) for r in dedup.resolve(df).collect()) == [(2, 0, None), (3, 1, 2)]
    assert dedup.resolve(df.limit(0)).collect() == []


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in "ab")
        assert dedup.common_subsequence(a, b) == slow(a, b)


def test_override(spark):
    df = spark.createDataFrame([(1, 1, 9, "domain_match", "SCORED"), (2, 1, 9, "domain_match", "SCORED")], "id long, is_duplicate int, duplicate_of_id long, duplicate_reason string, status string")
    got = {r.id: tuple(r)[1:] for r in dedup.override_duplicates(df, df.where("id = 1")).collect()}
    assert got == {1: (0, None, None, "NEW"), 2: (1, 9, "domain_match", "SCORED")}


def test_commit_facts(spark):
    rows = [("r", i, f"m{i:03}") for i in range(150)] + [("s", 1, "only")]
    got = {r.repo_url: (r.total_commits_seen, r.first_commit_message, r.single_commit_repo) for r in pages.commit_facts(spark.createDataFrame(rows, "repo_url string, ts int, message string")).collect()}
    assert got == {"r": (100, "m050", False), "s": (1, "only", True)}


def test_repo_summary(spark):
    df = spark.sql("SELECT struct(true AS checked, struct(1L AS total_commits_seen, 'init' AS first_commit_message, true AS single_commit_repo) AS evidence) AS c")
    assert one(df.select(pages.repo_summary(F.col("c")))) == '1 commits seen (API page) | ⚠️ single-commit repo | first commit: "init"'


@pytest.mark.parametrize(("text", "broken"), [("x" * 49, True), ("x" * 50, False), ("# 404\n\nPage Not Found, and a text that is long enough to count", True), ("Oops! " + "y" * 60 + " vanished", False), ("Oops! it has vanished, and the rest is long enough to be a page of text", True)])
def test_broken_pages(spark, text, broken):
    assert one(spark.createDataFrame([(text,)], "t string").select(pages.is_broken("t"))) is broken


def test_ratio_rounds_half_to_even(spark):
    df = spark.createDataFrame([("engineer sales marketing support designer recruiter finance growth",)], "t string")
    assert one(df.select(pages.careers_signal("t")["ratio"])) == 0.12


def test_empty_careers_page_as_text(spark):
    df = spark.createDataFrame([("  ",)], "t string")
    assert one(df.select(pages.careers_text(pages.careers_signal("t")))) == "[Careers signal — deterministic extraction, no raw text]\n- has_careers_page_content: False"


def test_verdict_edge_cases(spark):
    bodies = ['{"segment":"unclear","recommended_offer":"none","evidence_quotes":["A  b", "", "zz"]}', '{"segment":"too_big","confidence":null}', '{"segment":"too_big","confidence":"0.9"}', "[1]", None, '{"segment":"x","confidence":0.9,"recommended_offer":"none","disqualify_reason":"r"}']
    df = spark.createDataFrame([(i, b, "some a B text") for i, b in enumerate(bodies)], "lead_id long, body string, context string")
    got = {r.lead_id: r for r in verdicts.finish(df).collect()}
    assert got[0].evidence_quotes == ["A  b", ""] and got[0].confidence == 0 and got[0].disqualify_reason == "ungrounded_evidence_quotes_removed: 1 citation(s) not found in source text"
    assert [got[i].parse_failed for i in range(6)] == [False, True, True, True, True, False]
    assert got[5].segment == "unclear" and got[5].confidence == 0.3 and got[5].disqualify_reason == "r | invalid_segment_fixed_to_unclear" and got[5].status == "LOW_CONFIDENCE"


def test_evidence_blocks_and_reports(spark):
    raw = spark.createDataFrame([(1, 7, "linkedin", "q", '[{"url":"u/company/x","title":"T","content":" c "},{"url":"","title":"no"},{"url":"v"}]'), (2, 7, "github", "q2", '{"error":"boom"}'), (3, 7, "linkedin", "q3", '[{"url":"w","title":"W","content":"d"}]')], "id long, lead_id long, source string, query string, results string")
    ev = evidence.parse_results(raw)
    clean = ev.select(evidence.clean_hits(F.col("results")).alias("h")).first().h
    assert [(h.url, h.title, h.content) for h in clean] == [("u/company/x", "T", " c "), ("v", "", "")]
    assert one(ev.where("id = 1").select(evidence.best_profile(F.col("results"))["title"])) == "T"
    merged = {r.source: [h.url for h in r.results] for r in evidence.merge_by_source(ev).collect()}
    assert merged == {"linkedin": ["u/company/x", "", "v", "w"]}
    block = verdicts.evidence_block(ev).first().evidence_block
    assert block.endswith("[linkedin] T (u/company/x)\nc\n\n[linkedin] W (w)\nd")
    own = spark.createDataFrame([(7, "C", "s", 0), (8, "D", "t", 0)], "id long, company_name string, website_url string, is_duplicate int")
    report = [tuple(r) for r in reports.search_report(own, ev).collect()]
    assert sorted(r[6] for r in report) == ["", "ERROR", "T", "W", "no"] and all(r[0] == 7 for r in report)
    assert [r.id for r in evidence.leads_with_evidence(own, ev).collect()] == [7]
    ordered = ev.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "source", "results"))).alias("e"))
    assert one(ordered.select(evidence.titles_summary(F.col("e")))) == "linkedin: T | no |  ||| github:  ||| linkedin: W"


def test_readable_report(spark):
    rows = spark.createDataFrame([(1, "C", "s", "NEW", 0), (2, "D", "t", "NEW", 1)], "id long, company_name string, website_url string, status string, is_duplicate int")
    stored = spark.createDataFrame([(1, 1, "homepage", "a\n b"), (1, 2, "homepage", "later"), (1, 3, "about", "z" * 500)], "lead_id long, id long, source string, content string")
    signals = spark.sql("SELECT 1L AS lead_id, 1L AS id, 'v0' AS generator_fingerprint, '' AS generator_meta_tag, array('Geist') AS trend_fonts, cast(array() AS array<string>) AS visual_patterns, cast(array() AS array<string>) AS build_tool_phrases, cast(array() AS array<string>) AS style_phrases, 'none' AS style_density, cast(array() AS array<string>) AS disclosures, '' AS repo_url")
    ev = spark.createDataFrame([], "id long, lead_id long, source string, query string, results array<struct<url:string,title:string,content:string>>, error string")
    got = {r.lead_id: r for r in reports.readable_report(rows, stored, signals, ev).collect()}
    assert got[1].homepage_preview == "later" and got[1].about_preview == "z" * 400 + " …" and got[1].signals_summary == "AI generator detected: v0 | Trend fonts: Geist"
    assert got[2].signals_summary == "No technical signals computed." and got[2].careers_preview == "(page not found / not scraped)" and got[2].search_evidence == ""


def test_labels_and_reasons(spark):
    df = spark.createDataFrame([("FETCH_FAILED", "", "word " * 40, 0.7, "2024-02-03T07:05:00"), ("odd", "r", None, None, "soon")], "s string, r string, e string, c double, t string")
    got = df.select(reports.status_label("s").alias("a"), reports.reason_text(F.col("s"), F.col("r"), F.col("e")).alias("b"), reports.confidence_band("c").alias("c"), reports.shown_time("t").alias("d")).collect()
    assert got[0].a == "Scraping failures" and got[0].b.endswith("word...") and len(got[0].b) <= 160 and got[0].c == "success" and got[0].d == "3 Feb 2024, 07:05"
    assert (got[1].a, got[1].b, got[1].c, got[1].d) == ("odd", "r", "muted", "soon")


def test_errors(spark):
    df = spark.createDataFrame([("Insufficient credits",), ("rate limit, retry after 14s",), ("SSL SYSCALL error",), ("bad JSON",), ("x",), (None,)], "last_error string")
    assert {(r["class"], r.n, r.max_wait) for r in reports.error_report(df).collect()} == {("quota", 1, None), ("rate_limit", 1, 15.0), ("connection", 1, None), ("malformed_json", 1, None), ("other", 1, None)}


def test_folds(spark):
    ev = spark.createDataFrame([(1, 1, "NEW", "e", 2.0), (1, 2, None, "lost", None), (1, 3, "SCORED", None, None)], "lead_id long, seq long, status string, error string, scrape_seconds double")
    assert tuple(state.fold_progress(ev).first()) == (1, "SCORED", None, 3, 2.0)
    reviews = spark.createDataFrame([(1, 1, "APPROVED", None), (1, 2, "REJECTED", "too_big"), (1, 3, "MAYBE", None)], "lead_id long, seq long, review_status string, review_segment_override string")
    assert tuple(state.fold_reviews(reviews).first()) == (1, "REJECTED", "too_big")
    sessions = spark.createDataFrame([(1, 1, "running", None), (1, 2, "completed", "t"), (1, 3, "failed", None)], "session_id long, seq long, status string, completed_at string")
    assert tuple(state.fold_sessions(sessions).first()) == (1, "failed", "t")
    settings = spark.createDataFrame([(1, 1, '["a"]', "[3,1]"), (1, 2, "bad", None)], "session_id long, seq long, criteria string, batch string")
    assert tuple(state.session_settings(settings).first()) == (1, [], [3, 1])


def test_rescore(spark):
    raw = spark.createDataFrame([(1, '{"segment":"too_big","confidence":0.9,"recommended_offer":"none","evidence_quotes":["hello"]}'), (2, "{}")], "lead_id long, body string")
    stored = spark.createDataFrame([(1, 1, "homepage", "Hello there")], "lead_id long, id long, source string, content string")
    got = {r.lead_id: (r.status, r.segment, r.disqualify_reason) for r in state.rescore(raw, stored).collect()}
    assert got == {1: ("SCORED", "too_big", None), 2: ("RESCORE_FAILED", "unclear", "no_scraped_content")}
    empty = stored.where("false").unionByName(spark.createDataFrame([(1, 1, "homepage", ""), (1, 2, "about", None), (2, 3, "about", "")], stored.schema))
    got = {r.lead_id: (r.status, r.disqualify_reason, r.confidence, r.parse_failed) for r in state.rescore(raw, empty).collect()}
    assert got == {i: ("LOW_CONFIDENCE", "no_content_scraped", 0.0, False) for i in (1, 2)}
    ev = spark.sql("SELECT 1L AS id, 1L AS lead_id, 'crunch' AS source, array(named_struct('url', 'u', 'title', 't', 'content', 'some text')) AS results")
    got = {r.lead_id: (r.status, r.disqualify_reason) for r in state.rescore(raw, empty, ev).collect()}
    assert got[1][0] == "LOW_CONFIDENCE" and got[1][1].startswith("ungrounded") and got[2] == ("LOW_CONFIDENCE", "no_content_scraped")
    own = spark.createDataFrame([(1,), (2,)], "id long")
    events, left = state.rescore_reset(own, raw, own.where("id = 1"))
    assert [r.lead_id for r in events.collect()] == [1] and [r.lead_id for r in left.collect()] == [2]


def test_values_of_other_types_in_verdicts(spark):
    body = '{"segment":"too_big","confidence":0.9,"recommended_offer":"none","evidence_quotes":%s,"needs_human_review":%s}'
    cases = [('[5, true, {"a":1}, "ok", null]', "false"), ('["ok"]', '"yes"'), ('["ok"]', "0"), ('["ok"]', "1.5"), ('["ok"]', '""'), ('["ok"]', "[]"), ('["ok"]', '{"a":0}'), ("[]", "null"), ('["ok"]', '"false"'), ('"ok"', "0.0")]
    raw = spark.createDataFrame([(i, body % c, 'ok 5 true {"a":1}') for i, c in enumerate(cases)], "id long, body string, context string")
    got = {r.id: r for r in verdicts.finish(raw).collect()}
    assert got[0].evidence_quotes == ["ok"] and got[0].disqualify_reason == "ungrounded_evidence_quotes_removed: 4 citation(s) not found in source text"
    assert [got[i].needs_human_review for i in range(len(cases))] == [True, True, False, True, False, False, True, False, True, False]
    assert got[7].evidence_quotes == [] and got[9].evidence_quotes == []


def test_stored_attempts_fit_the_choice(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"lead_id": 1, "attempt": 1, "body": "no", "error": "line 1"}\n{"lead_id": 1, "attempt": 2, "body": null, "error": "timeout"}\n{"lead_id": 2, "attempt": 1, "body": "{}"}\n')
    got = {r.lead_id: (r.used, r.disqualify_reason) for r in verdicts.choose_attempt(tables.read_raw_verdicts(spark, str(tmp_path / "raw.json"))).collect()}
    assert got == {1: (0, "json_parse_failed: line 1 | retry_error: timeout"), 2: (1, None)}


def test_lookup_order_and_owner(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, session_id long")
    ids = spark.createDataFrame([([3, 9, 1, 3],)], "ids array<long>")
    assert [r.id for r in leads.ordered_lookup(ids, rows).orderBy("pos").collect()] == [3, 1, 3]
    sessions = spark.createDataFrame([(1, 5), (2, None)], "id long, owner_id long")
    assert [r.id for r in leads.scan(rows, sessions=sessions, owner_id=5).collect()] == [1]


def test_sinks_and_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b', None)], "id long, t string, e string")
    reports.write_csv(rows, str(tmp_path / "csv"), ["id"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()] == [("1", 'a "q", b', None)]
    own = spark.createDataFrame([(1, 4), (2, 5)], "id long, session_id long")
    data = spark.createDataFrame([(1, "x"), (2, "y")], "lead_id long, v string")
    tables.append(data, own, str(tmp_path / "t"))
    tables.append(data, own, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("session_id").count().count() == 2
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "session_id=5").iterdir()}
    assert tables.drop_session(spark, [str(tmp_path / "t"), str(tmp_path / "none")], 4) == [str(tmp_path / "t" / "session_id=4")]
    assert [r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["y", "y"]
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "session_id=5").iterdir()} == before and tables.drop_session(spark, [str(tmp_path / "t")], 4) == []


def test_a_session_goes_from_all_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 4), (2, 5), (3, 5)], "id long, session_id long")
    for t in tables.SESSION_TABLES:
        rows.write.partitionBy("session_id").parquet(str(tmp_path / t))
    assert len(tables.delete_session_tables(spark, str(tmp_path), 5)) == 6
    assert all([r.id for r in spark.read.parquet(str(tmp_path / t)).collect()] == [1] for t in tables.SESSION_TABLES)


def test_split_csv_equals_whole_files(spark, tmp_path):
    rng = random.Random(2)
    fields = ["", "a", "b c", 'say ""hi""', "line\nbreak", "\n\n", "x, y", "\r\nwin", "é\n" * 40, " pad "]
    lines = ["Email,Company name,note"]
    for i in range(120):
        values = [rng.choice(fields) for _ in range(3)]
        lines.append(",".join(f'"{v}"' if v == "" or any(c in v for c in '",\n\r') or rng.random() < 0.3 else v for v in values) or str(i))
    end = {"a": "\n", "b": "\r\n"}
    for name, sep in end.items():
        (tmp_path / f"{name}.csv").write_bytes(sep.join(lines).encode() + (sep.encode() if name == "b" else b""))
    for path in (str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path)):
        want = [tuple(r) for r in tables.read_contact_csv(spark, path).collect()]
        for size in ("128m", "900"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                got = tables.read_split_csv(spark, path)
                rows = [tuple(r) for r in got.collect()]
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert got.columns == ["Email", "Company name", "note"] and sorted(map(str, rows)) == sorted(map(str, want))
            if path.endswith(".csv"):
                assert rows == want


def test_log_of_changes(spark):
    progress = spark.createDataFrame([(1, 1, "FETCHED", "late", 2.0), (1, 5, "SCORED", None, None), (1, 7, None, "no", 3.0), (2, 2, "SCORE_FAILED", "e", None)], "lead_id long, seq long, status string, error string, score_seconds double")
    reviews = spark.createDataFrame([(1, 3, "APPROVED", "too_big", "t1"), (1, 4, "OTHER", "x", "t2"), (2, 9, "REJECTED", None, "t3")], "lead_id long, seq long, review_status string, review_segment_override string, reviewed_at string")
    marks = spark.createDataFrame([(2, 1, "manual", 3), (3, 1, "manual", 3), (4, 1, "manual", 3)], "id long, duplicate_of_id long, duplicate_reason string, seq long")
    back = spark.createDataFrame([(3, 8), (4, 2)], "id long, seq long")
    log = event_log.merged(event_log.of_progress(progress), event_log.of_reviews(reviews), event_log.of_marks(marks), event_log.of_overrides(back), event_log.of_statuses(back.where("id = 4"), "RESCORE_PENDING"))
    own = spark.createDataFrame([(i, "OLD", "olderror", 0, "keep") for i in range(1, 6)], "id long, status string, last_error string, is_duplicate int, extra string")
    got = {r.id: r for r in event_log.apply(own, event_log.fold(log)).collect()}
    assert (got[1].status, got[1].last_error, got[1].score_seconds, got[1].review_status, got[1].reviewed_at) == ("SCORED", None, 3.0, "APPROVED", "t1")
    assert (got[2].status, got[2].last_error, got[2].is_duplicate, got[2].duplicate_of_id, got[2].review_status, got[2].review_segment_override) == ("SCORE_FAILED", "e", 1, 1, "REJECTED", None)
    assert (got[3].status, got[3].is_duplicate, got[3].duplicate_of_id, got[3].last_error) == ("NEW", 0, None, "olderror")  # 8 comes after 3
    assert (got[4].status, got[4].is_duplicate, got[4].duplicate_reason) == ("RESCORE_PENDING", 1, "manual")  # one number: the larger value; 3 comes after 2
    assert (got[5].status, got[5].last_error, got[5].is_duplicate, got[5].extra) == ("OLD", "olderror", 0, "keep")
    with pytest.raises(ValueError):
        event_log.events(own, "id", F.lit(1), extra="extra")


def test_streams(spark, tmp_path):
    ev = spark.sql("SELECT cast(id % 3 AS long) AS session_id, id AS seq, id AS lead_id, 'done' AS step, 'SCORED' AS status, cast(null AS string) AS error, timestamp'2024-01-01' AS ts FROM range(50)")
    ev.write.parquet(str(tmp_path / "ev"))
    later = ev.where("session_id > 0").selectExpr("session_id", "seq + 100 AS seq", "lead_id", "'scoring' AS step", "status", "error", "ts")
    for more in (None, later):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "ev"))
        flows.follow_progress(flows.progress_stream(spark, str(tmp_path / "ev")), str(tmp_path / "progress"), str(tmp_path / "cp")).awaitTermination()
        want = state.latest_progress(ev if more is None else ev.unionByName(more)).collect()
        assert sorted(tuple(r) for r in flows.current_progress(spark, str(tmp_path / "progress")).collect()) == sorted(tuple(r) for r in want)

    (tmp_path / "in").mkdir()
    header = ["Company", "Website", "Email"]
    for i, line in enumerate(("Acme,acme.io,a@acme.io", "Acme Two,www.acme.io,b@acme.io\nOther,other.io,")):
        (tmp_path / "in" / f"{i}.csv").write_text(",".join(header) + "\n" + line + "\n")
        flows.take_in(flows.intake_stream(spark, str(tmp_path / "in"), header), str(tmp_path / "leads"), 3, str(tmp_path / "cp2")).awaitTermination()
    got = sorted((r.id, r.company_name, r.is_duplicate, r.duplicate_of_id) for r in spark.read.parquet(str(tmp_path / "leads")).collect())
    assert got == [(1, "Acme", 0, None), (2, "Acme Two", 1, 1), (3, "Other", 0, None)]


def test_blocks_of_many_small_parts_are_bounded_and_whole(spark):
    pages = spark.range(1500).select((F.col("id") % 1).alias("lead_id"), "id", F.lit("").alias("source"), F.lit("x").alias("content"))
    whole = "\n\n---\n\n".join(["## Source: \nx"] * 1500)
    for n in (12000, 11994, 13):
        assert verdicts.site_context(pages, max_chars=n).first().context == whole[:n]
    assert "WindowGroupLimit" in verdicts.site_context(pages)._jdf.queryExecution().executedPlan().toString()
    hit = F.array(F.struct(F.lit("").alias("url"), F.lit("").alias("title"), F.lit("x").alias("content")))
    evidence = spark.range(1500).select((F.col("id") % 1).alias("lead_id"), "id", F.lit("").alias("source"), hit.alias("results"))
    block = verdicts.evidence_block(evidence, max_chars=3000).first().evidence_block
    assert block.endswith("\n\n".join(["[]  ()\nx"] * 1500)[:3000])
    assert "WindowGroupLimit" in verdicts.evidence_block(evidence, max_chars=3000)._jdf.queryExecution().executedPlan().toString()


def test_broken_pages_hide_no_later_ones(spark):
    good, shell = "a real homepage with quite enough text in it to be kept as it is", "the same shell text again and again on every route of this site"
    rows = [(1, 1, "homepage", good), (1, 2, "about", "x"), (1, 3, "product", "x"), (1, 4, "careers", shell), (1, 5, "pricing", shell), (2, 6, "homepage", "404"), (2, 7, "about", good)]
    rows += [(3, 8, "homepage", good), (3, 9, "about", "long text " * 3300 + "page not found")]  # the mark is behind what is stored
    df = spark.createDataFrame([(*r, "u") for r in rows], "site long, id long, source string, content string, url string")
    got = {r.site: (r.n_kept, r.n_unusable, r.status, r.last_error) for r in pages.fetch_status(df).collect()}
    assert got == {1: (2, 3, "FETCH_PARTIAL", None), 2: (0, 2, "FETCH_FAILED", "homepage_render_error_or_empty_content"), 3: (2, 0, "PARSED", None)}
    kept = {r.id: r.content for r in pages.kept_pages(df).collect()}
    assert sorted(kept) == [1, 4, 8, 9] and kept[4].startswith("[Careers signal") and len(kept[9]) == 32000
    assert pages.kept_pages(df.limit(0)).collect() == []


def test_confidence_is_judged_at_the_top(spark):
    rows = [(1, '{"segment":"too_big","confidence":"0.9","x":{"confidence":0.5}}'), (2, '{"segment":"too_big","confidence":0.9,"x":{"confidence":"0.5"}}'), (3, '{"confidence":null}'), (4, '{"segment":"too_big"}'), (5, "[1]"), (6, None), (7, '{"confidence":1,"confidence":0.8,"segment":"too_big"}')]
    got = {r.lead_id: (r.parse_failed, r.confidence) for r in verdicts.parse(spark.createDataFrame(rows, "lead_id long, body string")).collect()}
    assert got == {1: (True, 0.0), 2: (False, 0.9), 3: (True, 0.0), 4: (False, 0.0), 5: (True, 0.0), 6: (True, 0.0), 7: (False, got[7][1])}


def test_second_attempts_count_if_the_first_fails(spark):
    good = '{"segment":"too_big","confidence":0.9,"recommended_offer":"none","evidence_quotes":["only late","early"]}'
    rows = [(1, 1, good, None), (1, 2, "bad", "e"), (2, 1, "bad", "e1"), (2, 2, good, None), (3, 1, "bad", "e1"), (3, 2, "bad", "e2"), (3, 3, good, None), (4, 5, "bad", "e5")]
    raw = spark.createDataFrame(rows, "lead_id long, attempt long, body string, error string")
    contexts = spark.createDataFrame([(i, "early text, and only late text", "early text") for i in (1, 2, 3)], "lead_id long, context string, retry_context string")
    got = {r.lead_id: r for r in verdicts.finish_attempts(verdicts.choose_attempt(raw), contexts).collect()}
    assert [got[i].used for i in (1, 2, 3, 4)] == [1, 2, 0, 0]
    assert got[1].evidence_quotes == ["only late", "early"] and got[2].evidence_quotes == ["early"] and got[2].status == "LOW_CONFIDENCE"
    assert got[3].disqualify_reason == "json_parse_failed: e1 | retry_error: e2" and got[4].disqualify_reason == "json_parse_failed: e5 | retry_error: no second attempt"


def test_ids_follow_the_order_of_rows(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("a.b"))
    got = ingest.with_ids(df, after=5)
    assert got.columns == ["id", "a.b"] and sorted(tuple(r) for r in got.collect()) == [(i + 6, i) for i in range(1000)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and ingest.with_ids(df.limit(0)).collect() == []


def test_known_originals_are_matched_and_not_decided_again(spark):
    schema = "id long, email string, domain_normalized string, company_name string"
    old = spark.createDataFrame([(1, "a@x.io", "x.io", "Acme Tools"), (2, "b@y.io", "y.io", "Bright Labs Berlin")], schema)
    new = spark.createDataFrame([(3, "A@x.io", "z.io", "Zed"), (4, "", "z.io", "Other"), (5, "", "", "Bright Labs Berlyn"), (6, "", "", ""), (7, "", "q.io", "Q"), (8, "", "q.io", "")], schema)
    got = {r.id: (r.is_duplicate, r.duplicate_of_id, r.duplicate_reason) for r in dedup.resolve(new, originals=old).collect()}
    assert got == {3: (1, 1, "exact_email"), 4: (0, None, None), 5: (1, 2, "fuzzy_company_name"), 6: (0, None, None), 7: (0, None, None), 8: (1, 7, "domain_match")}
    both = {r.id: (r.is_duplicate, r.duplicate_of_id, r.duplicate_reason) for r in dedup.resolve(old.unionByName(new)).collect()}
    assert {i: x for i, x in both.items() if i > 2} == got


def test_resolution_against_the_nested_loop(spark):
    rng = random.Random(3)
    words = ["north", "south", "tools", "labs", "works", "data"]
    rows = [(i, rng.choice(["", f"u{rng.randrange(12)}@m.io"]), rng.choice(["", f"d{rng.randrange(12)}.io"]), " ".join(rng.choice(words) for _ in range(3)) + rng.choice(["", "s", " x"])) for i in range(120)]
    originals, want = [], {}
    for i, mail, domain, name in rows:
        key = " ".join(sorted(name.split()))
        near = lambda o: 200 * dedup.common_subsequence(key, o[3]) >= 90 * (len(key) + len(o[3]))
        for reason, test in (("exact_email", lambda o: mail and o[1] == mail), ("domain_match", lambda o: domain and o[2] == domain), ("fuzzy_company_name", near)):
            hit = next((o for o in originals if test(o)), None)
            if hit:
                want[i] = (1, hit[0], reason)
                break
        else:
            originals.append((i, mail, domain, key))
            want[i] = (0, None, None)
    got = dedup.resolve(spark.createDataFrame(rows, "id long, email string, domain_normalized string, company_name string")).collect()
    assert {r.id: (r.is_duplicate, r.duplicate_of_id, r.duplicate_reason) for r in got} == want


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Box

    cluster = Box(conf=Box(get=lambda *_: None), sparkContext=Box(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(cluster)


def test_similar_names_with_common_words_against_all_pairs(spark):
    r = random.Random(7)
    names = set()
    for _ in range(50):
        name = "".join(r.choice("ab\u00e9") for _ in range(r.randint(1, 9))) + r.choice([" solutions", " consulting group", ""])
        names.add(name)
        for _ in range(2):
            x = list(name)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(x) + 1)
                if r.random() < 0.5 and k < len(x):
                    x.pop(k)
                else:
                    x.insert(k, r.choice("abz"))
            names.add("".join(x))
    names.discard("")
    want = {(a, b) for a in names for b in names if a != b and 200 * dedup.common_subsequence(a, b) >= 90 * (len(a) + len(b))}
    assert len(want) > 100
    df = spark.createDataFrame([(n,) for n in names], "name_key string")
    for options in ({}, {"hot": 8, "meetings": 0}, {"hot": 8, "depth": 1}):
        assert {(x.a, x.b) for x in dedup.similar_names(df, 90, **options).collect()} == want
    low = {(a, b) for a in names for b in names if a != b and 200 * dedup.common_subsequence(a, b) >= 60 * (len(a) + len(b))}
    for options in ({}, {"hot": 64, "levels": 2, "meetings": 3}):  # short names meet by segments here
        assert {(x.a, x.b) for x in dedup.similar_names(df, 60, **options).collect()} == low


def test_many_names_that_share_a_word_make_few_pairs(spark):
    own = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 10), "0123456789", "ghijklmnop")
    names = spark.range(3000).select(F.concat(own, F.lit(" solutions")).alias("name_key"))
    pairs = {(x.a, x.b) for x in dedup.similar_names(names, hot=256).collect()}
    assert all((b, a) in pairs and dedup.common_subsequence(a, b) >= 18 for a, b in pairs) and len(pairs) < 100


def test_names_are_compared_by_marks_before_edits(spark):
    r = random.Random(11)
    names = {"a", "aa", "aaaaaaaaaaaaaaaaaaab", "\U0001f600 été", "x" * 300}
    for _ in range(60):
        name = "".join(r.choice("abé \U0001f600") for _ in range(r.randint(1, 40)))
        k = r.randrange(len(name))
        names |= {name, name[:k] + name[k + 1 :], name[:k] + "b" + name[k:], name + name}
    names.discard("")
    df = spark.createDataFrame([(n,) for n in names], "name_key string")
    for threshold in (90, 60):
        want = {(a, b) for a in names for b in names if a != b and 200 * dedup.common_subsequence(a, b) >= threshold * (len(a) + len(b))}
        assert len(want) > 100
        assert {(x.a, x.b) for x in dedup.near_names(df, df, threshold).collect()} == want
    marked = dedup.with_marks(df)
    plan = dedup._directly(F.broadcast(marked), marked, 90)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "NestedLoopJoin" in line)
    assert 0 < join.index("bit_count") < join.index("levenshtein")
