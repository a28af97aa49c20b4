import pytest

from lumenspan.functions import query as Q
from lumenspan.functions.stem import porter1, porter2


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("run", '"run"'),
        ("budget", '"budget"*'),
        ("계약서", '("계약서"* OR ("contract"* OR "계약"*))'),
        ("api", '"api"*'),
        ("年度報告", '("年度"* AND "度報"* AND "報告"*)'),
        ('"annual report" 2023', '("annual report" AND "2023"*)'),
    ],
)
def test_expression(text, expected):
    assert str(Q.parse(text)) == expected


@pytest.mark.parametrize("text", ["", "   ", None, "the a an is are", '""'])
def test_nothing_to_search(text):
    assert Q.parse(text) is None


def test_hyphens_and_prefixes():
    assert Q.hyphen_expansions("e-mail") == ["email"]
    assert Q.hyphen_expansions("reindex") == ["index"]
    assert Q.hyphen_expansions("preconfigure uninstall") == ["configure", "install"]
    assert "onpremise" in Q.hyphen_expansions("on-premise")
    for plain in ("run", "계약서", "budget"):
        assert Q.hyphen_expansions(plain) == []
    text = str(Q.parse("re-index"))
    assert "OR" in text and "reindex" in text


def test_stop_words_and_particles():
    assert Q.remove_stop_words("how to configure the network settings") == "configure network settings"
    assert Q.remove_stop_words("budget report") == "budget report"
    assert Q.remove_stop_words("계약서를 검토") == "계약서 검토"


def test_expansion_table():
    assert Q.expand("word")[-1] == "워드" and Q.keyword_expansions("word") == ["워드"]
    assert Q.keyword_expansions("photo") == ["사진"]


def test_stems():
    words = ["documents", "running", "configuration"]
    assert [porter2(w) for w in words] == ["document", "run", "configur"]
    assert [porter1(w) for w in ("caresses", "ponies", "relational", "hopping", "generalizations", "probate", "controll")] == ["caress", "poni", "relat", "hop", "gener", "probat", "control"]
    assert [porter2(w) for w in ("generously", "dying", "happily", "news", "consign", "knightly", "보고서")] == ["generous", "die", "happili", "news", "consign", "knight", "보고서"]


# Queries in words and their expressions, written by hand from the rules.
EXPRESSIONS = [
    ("run", '"run"'),
    ("budget", '"budget"*'),
    ("the a an is are", None),
    ("", None),
    ("budget report", '(("budget"* OR "report"*) OR "port"*)'),
    ("how to configure the network settings", '(("configure"* OR "network"* OR "settings"*) OR "nfigure"*)'),
    ('"annual report"', '"annual report"'),
    ('"annual report" 2023', '("annual report" AND "2023"*)'),
    ('"a b" "c d" e', '("a b" AND "c d" AND "e")'),
    ('say "" hi', '("say" OR "hi")'),
    ("api key", '("api"* OR "key")'),
    ("cad", '("cad" OR "도면"*)'),
    ("e-mail", '(("e" OR "mail"*) OR "email"*)'),
    ("re-index", '(("re" OR "index"*) OR "reindex"*)'),
    ("reindex", '("reindex"* OR "index"*)'),
    ("계약서", '("계약서"* OR ("contract"* OR "계약"*))'),
    ("보고서양식", '("보고서양식"* OR ("보고"* AND "서양"*))'),
    ("年度報告", '("年度"* AND "度報"* AND "報告"*)'),
    ("年度", '"年度"*'),
    ("photo", '("photo"* OR "사진"*)'),
    ("word excel", '(("word"* OR "excel"*) OR ("워드"* OR "엑셀"* OR "cel"*))'),
]


def test_expressions():
    assert [(q, str(e) if (e := Q.parse(q)) is not None else None) for q, _ in EXPRESSIONS] == EXPRESSIONS


# Words with their stems by the two published algorithms (the second's from its published sample vocabulary).
STEMS = [
    ("caresses", "caress", "caress"), ("ponies", "poni", "poni"), ("ties", "ti", "tie"), ("cats", "cat", "cat"), ("agreed", "agre", "agre"), ("plastered", "plaster", "plaster"),
    ("motoring", "motor", "motor"), ("hopping", "hop", "hop"), ("falling", "fall", "fall"), ("filing", "file", "file"), ("happy", "happi", "happi"), ("sky", "sky", "sky"),
    ("relational", "relat", "relat"), ("conditional", "condit", "condit"), ("hopefulness", "hope", "hope"), ("formalize", "formal", "formal"), ("electrical", "electr", "electr"), ("adjustment", "adjust", "adjust"),
    ("consigned", "consign", "consign"), ("consistency", "consist", "consist"), ("consolatory", "consolatori", "consolatori"), ("conspiracy", "conspiraci", "conspiraci"), ("knackeries", "knackeri", "knackeri"), ("knives", "knive", "knive"),
    ("documents", "document", "document"), ("running", "run", "run"), ("configuration", "configur", "configur"), ("dying", "dy", "die"), ("news", "new", "news"), ("보고서", "보고서", "보고서"),
]


def test_stems():
    from lumenspan.functions.stem import porter1, porter2

    assert [(w, porter1(w), porter2(w)) for w, _, _ in STEMS] == STEMS


def test_sizes_and_roots():
    from lumenspan.sources import scan

    assert [scan.parse_size(s) for s in ("10MB", "7", "1.5 KB", "2gb", "12B")] == [10 << 20, 7, 1536, 2 << 30, 12]
    assert scan.scan_roots(["/a", "/b"], {"scan_roots": ["/s"]}) == ["/a", "/b"]
    assert scan.scan_roots(None, {"scan_roots": ["/s"]}) == ["/s"] and scan.scan_roots([], {}, "/home/me") == ["/home/me"]
