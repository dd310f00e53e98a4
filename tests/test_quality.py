import pytest

from copyloom import rules
from copyloom.operators import quality

GOOD_TABLE = "\n".join(["FAQ Coverage Check", "Category\tStatus\tQuestion #", *[f"{c}\t✅\tQ1" for c in rules.FAQ_CATEGORIES]])


def good(faq=8, words=50, table=GOOD_TABLE):
    questions = "\n".join(f"### Question {i}?\n{' '.join(['word'] * words)}" for i in range(faq))
    return (
        "## 📝 Collection Page Copy — English Version\n"
        "Solid **lamp** for desks.\n### Part\ntext\n"
        f"## Frequently Asked Questions about lamps\n{questions}\n"
        f"## More\n{table}\n"
        "## 📝 中文对照版（供人工校验）\nx\n## 📚 数据来源列表\nName | https://a.example/ | 2024-01-01\n\n## ✅ 最终自检清单\ndone"
    )


KEYWORDS = ["lamp", "", *[f"k{i}" for i in range(5)]]


@pytest.fixture
def check(spark):
    def run(text, keywords=("lamp",), wanted=None):
        df = spark.createDataFrame([(1, text, list(keywords))], "id int, text string, keywords array<string>")
        rows = [(r["check"], r.detail, r.n) for r in quality.check_texts(df).collect()]
        return sorted((c, d, n) for c, d, n in rows if wanted is None or c in wanted)

    return run


def test_good_text(check):
    assert check(good()) == [("keyword_count", None, 1)]
    many = check(good(), KEYWORDS)
    assert {c for c, _, _ in many} == {"keyword_bold"} and all(n == 0 for _, _, n in many)


def test_banned_words(check):
    text = "we ELEVATE and elevate; re-elevated enriched Rich. A delicate dance, éRich\nMoreover x\nand Moreover y\n moreovers"
    assert check(text, wanted={"banned_word", "banned_opener"}) == [
        ("banned_opener", "Moreover", 1),
        ("banned_word", "marketing: elevate", 2),
        ("banned_word", "modifier: delicate dance", 1),
        ("banned_word", "modifier: rich", 1),
    ]


@pytest.mark.parametrize("uses, bad", [(3, False), (4, True)])
def test_keyword_uses(check, uses, bad):
    found = check("Lamp " * uses, wanted={"keyword_overused"})
    assert found == ([("keyword_overused", "lamp", uses)] if bad else [])


@pytest.mark.parametrize("bold, bad", [(0, True), (1, False), (3, False), (4, True)])
def test_keyword_bold(check, bold, bad):
    found = check("lamp " + "**Lamp** " * bold, wanted={"keyword_bold"})
    assert found == ([("keyword_bold", "lamp", bold)] if bad else [])


def test_pattern_signs_in_keywords_are_literal(check):
    assert check("a.c abc (x a.c a.c a.c", ["a.c", "(x"], {"keyword_overused"}) == [("keyword_overused", "a.c", 4)]


def test_headings(check):
    assert check("# T\n## A\n#### B\n### C\n##### D\n####no", wanted={"h1_used", "heading_jump"}) == [
        ("h1_used", None, 1), ("heading_jump", "B", 4), ("heading_jump", "D", 5),
    ]
    assert check("### A", wanted={"heading_jump"}) == [("heading_jump", "A", 3)]
    assert check("## A\n### B\n## C", wanted={"heading_jump"}) == []


@pytest.mark.parametrize(
    "first, bad",
    [("Welcome to us", True), ("are you looking for x", True), ("**Unlock** it", True), ("Richer soil", False), ("A welcome to all", False)],
)
def test_opening(check, first, bad):
    assert bool(check(f"## T\n\n \n{first}\nWelcome to", wanted={"opening"})) == bad


@pytest.mark.parametrize("n, bad", [(7, True), (8, False), (10, False), (11, True)])
def test_faq_count(check, n, bad):
    assert check(good(faq=n), wanted={"faq_count", "faq_missing"}) == ([("faq_count", None, n)] if bad else [])


def test_faq_missing(check):
    assert check("## Questions\n### a", wanted={"faq_count", "faq_missing", "answer_length"}) == [("faq_missing", None, 0)]


@pytest.mark.parametrize("words, bad", [(39, 8), (40, 0), (80, 0), (81, 8)])
def test_answer_length(check, words, bad):
    assert len(check(good(words=words), wanted={"answer_length"})) == bad


def test_answer_ends_at_deeper_heading(check):
    text = "## frequently asked questions\n### q\n" + "w " * 45 + "\n#### more\n" + "w " * 60 + "\n### r\n#### x\nw"
    assert check(text, wanted={"answer_length"}) == [("answer_length", "r", 0)]


def test_coverage(check):
    table = GOOD_TABLE.replace("Use Cases\t✅", "Use Cases\t✅ / ❌").replace("Trust & Safety\t✅\tQ1", "")
    assert check(good(table=table), wanted={"faq_category"}) == [
        ("faq_category", "Trust & Safety", 0), ("faq_category", "Use Cases", 0),
    ]


def test_modules(check):
    heads = [f"## {h}\n" for h in rules.MODULE_HEADINGS]
    wanted = {"module_missing", "module_order"}
    assert check("".join(heads), wanted=wanted) == []
    assert check("".join(heads[:2] + heads[3:]), wanted=wanted) == [("module_missing", "📚 数据来源列表", 0)]
    swapped = check("".join([heads[1], heads[0], *heads[2:]]), wanted=wanted)
    assert [(c, n) for c, _, n in swapped] == [("module_order", 4)]


def test_sources(check):
    text = "x | y\n## 📚 list\na | https://b | 2024\nonly | two\nn | b | c\n\n## ✅ end\nz | z"
    assert check(text, wanted={"source_row"}) == [("source_row", "n | b | c", 1), ("source_row", "only | two", 1)]


def test_unverified(check):
    assert check("a [Unverified] b [unverified]", wanted={"unverified"}) == [("unverified", None, 2)]


@pytest.mark.parametrize("n, bad", [(4, True), (5, False), (10, False), (11, True)])
def test_keyword_list(check, n, bad):
    assert bool(check("x", [f"k{i}" for i in range(n)], {"keyword_count"})) == bad


def test_missing_keywords(spark):
    df = spark.createDataFrame([(1, "x", None)], "id int, text string, keywords array<string>")
    assert ("keyword_count", 0) in [(r["check"], r.n) for r in quality.check_texts(df).collect()]
