"""Boundaries of the scalar rules: one unit before, at and after; null is neither zero nor false."""

import datetime as dt
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallyloom.functions import text, times, urls
from tallyloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def test_day_window_is_half_open(spark):
    p = ts("2026-10-08 01:00:00")
    for now, want in (("2026-10-08 00:59:59", False), ("2026-10-08 01:00:00", True), ("2026-10-09 00:59:59", True), ("2026-10-09 01:00:00", False)):
        assert one(spark, times.fresh(p, ts(now))) is want


def test_fixed_window_has_both_ends_and_unknown(spark):
    a, b = ts("2026-10-08 01:00:00"), ts("2026-10-09 01:00:00")
    for at, want in (("2026-10-08 00:59:59", False), ("2026-10-08 01:00:00", True), ("2026-10-09 01:00:00", True), ("2026-10-09 01:00:01", False), (None, None)):
        assert one(spark, times.in_closed_window(ts(at), a, b)) is want


def test_age_band_ends(spark):
    c = ts("2026-10-09 09:00:00")
    for at, want in (("2026-10-08 08:59:59", False), ("2026-10-08 09:00:00", True), ("2026-10-08 21:00:00", True), ("2026-10-08 21:00:01", False)):
        assert one(spark, times.age_between(ts(at), c)) is want


def test_edition_windows_and_labels(spark):
    for at, want in (("2026-10-09 08:59:59", "2026-10-09-am"), ("2026-10-09 09:00:00", "2026-10-09-pm"), ("2026-10-09 20:59:59", "2026-10-09-pm"), ("2026-10-09 21:00:00", "2026-10-10-am"), ("2026-12-31 23:00:00", "2027-01-01-am")):
        df = spark.range(1).select(ts(at).alias("t")).select(times.edition_label(times.edition_window(F.col("t"))["end"]).alias("x"))
        assert df.first().x == want


def test_deadlines_and_malformed_keys(spark):
    assert one(spark, times.deadline(F.lit("2026-10-09-am"))) == dt.datetime(2026, 10, 9, 9)
    assert one(spark, times.deadline(F.lit("2026-02-30-am"))) is None
    assert one(spark, times.deadline(F.lit("later"))) is None


def test_instants_need_an_offset(spark):
    assert one(spark, times.instant(F.lit("2026-10-09T09:00:00"))) is None
    assert one(spark, times.instant(F.lit("2026-10-09T09:00:00+09:00"))) == one(spark, times.instant(F.lit("2026-10-09T00:00:00Z")))
    assert one(spark, times.real_date(F.lit("2026-02-30"))) is None


def test_relative_ages(spark):
    seen = F.lit("2026-10-09 00:00:00").cast("timestamp")
    assert one(spark, times.relative_age(F.lit("3시간 전"), seen)) == one(spark, F.lit("2026-10-08 21:00:00").cast("timestamp"))
    assert one(spark, times.relative_age(F.lit("1개월 전"), seen)) == one(spark, F.lit("2026-09-11 00:00:00").cast("timestamp"))
    assert one(spark, times.relative_age(F.lit("방금"), seen)) is None
    assert one(spark, times.listed_time(F.lit("at 2026-10-09 09:00:00"))) == one(spark, F.lit("2026-10-09 00:00:00").cast("timestamp"))


def test_date_only_sources_wait_for_the_day_to_end(spark):
    assert one(spark, times.date_wholly_before(F.lit("2026-10-08").cast("date"), ts("2026-10-09 00:00:00"))) is True
    assert one(spark, times.date_wholly_before(F.lit("2026-10-09").cast("date"), ts("2026-10-09 21:00:00"))) is False


def test_monitor_precedence(spark):
    late, now = ts("2026-10-09 00:00:00"), ts("2026-10-09 01:00:00")
    assert one(spark, times.monitor_notice(F.lit("stopped"), late, now)) == "stopped"
    assert one(spark, times.monitor_notice(F.lit("retrying"), late, now)) == "overdue"
    assert one(spark, times.monitor_notice(F.lit("ok"), now, late)) is None


def test_canonical_forms_disagree(spark):
    u = F.lit("HTTPS://Ex.com:443/a;p?b=2&utm_x=1&a=&cooper=1&fbclid=9#f")
    assert one(spark, urls.canonical_sorted(u)) == "https://ex.com:443/a;p?a=&b=2&cooper=1"
    assert one(spark, urls.canonical_ordered(u)) == "https://ex.com:443/a?b=2&fbclid=9"
    assert one(spark, urls.canonical_plain(u)) == "https://ex.com/a;p?a=&b=2&cooper=1"
    assert one(spark, urls.without_fragment(u)).endswith("fbclid=9")


def test_public_urls(spark):
    for u, want in (("https://a.com/x", True), ("ftp://a.com", False), ("https://u@a.com", False), ("https://localhost/x", False), ("https://x.local/", False), ("https://a.com./", False), ("https://10.0.0.1/", False), (" https://a.com", False), (None, False)):
        assert one(spark, urls.is_public(F.lit(u).cast("string"))) is want, u


def test_post_ids(spark):
    assert one(spark, urls.post_identity(F.lit("https://aagag.com/issue/?idx=12_3"))) == "aagag-12"
    assert one(spark, urls.post_identity(F.lit("https://aagag.com/issue/?idx=1&idx=2"))) is None
    assert one(spark, urls.post_identity(F.lit("http://aagag.com/issue/?idx=1"))) is None
    assert one(spark, urls.post_number(F.lit("aagag-7-2"))) == "7"
    assert one(spark, urls.post_number(F.lit("https://other.com/?idx=7"))) is None
    assert one(spark, urls.strip_revision(F.lit("5_2"))) == "5"


def test_literal_count_does_not_fold(spark):
    assert one(spark, text.literal_count(F.lit("ㅋㅋᄏkㅋ"), "ㅋ")) == 3
    assert one(spark, text.literal_count(F.lit(None).cast("string"), "ㅋ")) is None


def test_title_rules_have_look_around(spark):
    codes = lambda s: [r.code for r in one(spark, text.classify_title(F.lit(s)))]
    assert codes("ㅇㅎ 사진") == ["source_title_nsfw_marker"]
    assert codes("ㅋㅇㅎ") == []
    assert codes("시신과 몰카") == ["graphic_or_death_title", "private_allegation_title"]
    assert one(spark, text.has_tag(text.nfc(F.lit("ㅇ​ㅎ")))) is True


def test_sections_keep_rule_order(spark):
    assert one(spark, text.section(F.lit("정치 경제"))) == "정치·정책"
    assert one(spark, text.section(F.lit("날씨"))) == "생활·안전"
    assert one(spark, text.section(F.lit("음악"))) is None


def test_similarity_order_matters(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("x", None)], "a string, b string")
    got = [r.r for r in df.select(text.similarity("a", "b").alias("r")).collect()]
    assert got == [SequenceMatcher(None, "tide", "diet").ratio(), SequenceMatcher(None, "diet", "tide").ratio(), None]
    assert one(spark, text.normalize_title(F.lit("  É  A "))) == "é a"


def test_phrases_and_tokens(spark):
    got = one(spark, text.emphasis_parts(F.lit("abcabd ab"), ["ab", "abc", ""]))
    assert [(p.text, p.bold) for p in got] == [("abc", True), ("ab", True), ("d ", False), ("ab", True)]
    assert one(spark, text.number_tokens(F.lit("매출 1,200억원, 3.5% 증가 2명"))) == ["1,200억원", "3.5%", "2명"]
    assert one(spark, text.source_names(F.lit("[a] 내용. 확인: 가, 나."))) == "가, 나"
    assert one(spark, text.bracket_prefix(F.lit("[a] 내용. 확인: 가"))) == "내용."
    assert one(spark, text.short_title(F.lit(" ".join("abc" for _ in range(26))))).count(" ") == 24
    assert one(spark, text.is_truncated(F.lit(" ".join("a" for _ in range(25))))) is False
    links = one(spark, text.social_links(F.lit("see x.com/a, https://instagram.com/b. not fox.com")))
    assert [(r.label, r.url) for r in links] == [("X", "https://x.com/a"), ("인스타", "https://instagram.com/b")]
    assert one(spark, text.overview_phrases(F.lit("짧은 문장. 3% 올랐다"), F.array(F.lit("올랐다")), F.array().cast("array<string>"))) == ["짧은 문장.", "올랐다", "3%"]


def test_fingerprint_ignores_order_and_case(spark):
    f = lambda **kv: one(spark, text.fingerprint(F.create_map(*(F.lit(x) for p in kv.items() for x in p))))
    assert f(a="X 1", b="y") == f(b="Y", a="x1")
    assert f(a="x") != f(a="y")


def test_safe_counts(spark):
    for s, want in (("0", 0), ("9007199254740991", 9007199254740991), ("9007199254740992", None), ("-1", None), ("1.5", None), (None, None)):
        assert one(spark, text.safe_count(F.lit(s).cast("string"))) == want


def test_encoding_keeps_escapes(spark):
    assert one(spark, text.encode_unicode(F.lit("https://a.com/%2Fé"))) == "https://a.com/%2F%C3%A9"


def test_archive_parser(spark):
    lines = ["# 지시", "- no", "## 2026-10-01 오전", "- 첫 \\[기록\\]", "    이어짐", "### 관찰", "-  볼 것", "## 2026-10-01 저녁", "- 둘째"]
    df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    got = sorted((r.date, r.edition, r.kind, r.text, r.line_start, r.line_end) for r in readers.archive(df).collect())
    assert got == [("2026-10-01", "am", "record", "첫 [기록] 이어짐", 4, 5), ("2026-10-01", "am", "watch", "볼 것", 7, 7), ("2026-10-01", "pm", "record", "둘째", 9, 9)]


def test_pages(spark):
    assert one(spark, readers.visible_text(F.lit("<p>a<script>b</script><br>c &amp; <i hidden>d</i>e"))) == "ac & e"
    assert one(spark, readers.is_challenge(F.lit("<title>Just a moment...</title>"))) is True
    assert one(spark, readers.assigned_json(F.lit('x\n AG_A.data = {"a": [1]};'), F.lit("data"))) == '{"a": [1]}'
    assert one(spark, readers.assigned_json(F.lit("x"), F.lit("data"))) is None
    body = '{"mode":"success","total":1,"comment":[{"w_idx":"5","w_content":"ㅋ","w_mb_id":"delete"}]}'
    df = spark.createDataFrame([(1, body)], "post long, body string")
    r = readers.comments(df, "post", "body").first()
    assert (r.cid, r.total, r.needs_verification) == ("5", 1, True)
    art = '<article><h2><a href="/o/r">x</a></h2> 1,234 stars today</article><article>none</article>'
    df = spark.createDataFrame([(1, art)], "page long, html string")
    assert [(r.rank, r.repo, r.stars_today) for r in readers.ranking(df, "page", "html").collect()] == [(1, "o/r", 1234)]


def test_social_links_by_the_signs_around_them(spark):
    """Any sign but a word's, an at-sign, a dot or a hyphen may stand before a link; a host goes on over word signs, dots and hyphens."""
    found = {
        "see:instagram.com/p": ["인스타 https://instagram.com/p"], "[x](https://x.com/a)": ["X https://x.com/a"], "링크instagram.com/b": ["인스타 https://instagram.com/b"],
        "x.com": ["X https://x.com/"], "HTTP://WWW.X.com?q=1 x.com#top": ["X http://www.x.com/?q=1", "X https://x.com/#top"], "(twitter.com/a), twitter.com/a!": ["X https://twitter.com/a"],
        "a@x.com": [], "_x.com": [], ".x.com": [], "-x.com": [], "fox.com": [], "x.com.evil": [], "x.com-a": [], "x.comet": [], "x.com:80/p": ["X https://x.com/"], "//x.com/p": ["X https://x.com/p"],
        "x.com/가\u3000y": ["X https://x.com/%EA%B0%80"], "<a href='https://m.instagram.com/q'>": ["인스타 https://m.instagram.com/q"], "a." * 5000 + "x.com": [], "": [],
    }
    df = spark.createDataFrame([(k,) for k in found], "t string")
    got = {r.t: [f"{x.label} {x.url}" for x in r.l] for r in df.select("t", text.social_links(F.col("t")).alias("l")).collect()}
    assert got == found
    assert one(spark, text.social_links(F.lit(None).cast("string"))) == []


def test_phrases_are_neither_blank_nor_ranges(spark):
    array = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    paragraphs = array("one two", "  three")
    assert [one(spark, text.phrases_occur(array(*p), paragraphs, 1, 2)) for p in (["one"], ["  "], [""], ["one", "three"], [], ["four"], ["one", "two", "three"])] == [True, False, False, True, False, False, False]
    shown = lambda t, c=(), e=(): one(spark, text.overview_phrases(F.lit(t), array(*c), array(*e)))
    assert shown("금리 3~5%, +1,200억원 −2.5%p") == ["금리 3~5%, +1,200억원 −2.5%p", "5%", "+1,200억원", "−2.5%p"]
    assert shown("당시 기록. 3%") == ["3%"] and shown("주요 기록: 셋. 넷") == ["셋."]
    assert shown("a b c d e f", ["", "a", "b", "c", "d"]) == ["a b c d e f", "a", "b", "c"]
    assert shown("a b", ["a"], [""]) == [] and shown("a b", ["a"], ["b", "z"]) == ["b"]
    assert one(spark, text.number_tokens(F.lit("3~5% 7명"))) == ["3~5%", "7명"]


def test_words_are_counted_without_a_split(spark):
    """Within lambdas a split would compile its pattern for every text: 9 of 25 samples of a gate stood there."""
    said = [(None,), ("",), ("  ",), ("a",), (" a\tb  c\n",), ("가 나",), ("x y z",)]
    rows = spark.createDataFrame(said, "t string").select("t", F.size(text.words(F.col("t"))).alias("n"), text.word_count(F.col("t")).alias("m")).collect()
    assert [r.n for r in rows] == [r.m for r in rows] and [r.m for r in rows if r.t == " a\tb  c\n"] == [3]
