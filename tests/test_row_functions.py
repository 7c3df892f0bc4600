"""Row functions that need no Spark."""

from lectern.operators import abstracts, publisher_xml, scripts


def test_scripts():
    page = '<script>var d = {"a": {"b": "x}\\"y"}};</script><script type="application/ld+json">[{"author": [{"name": "A  B"}, "C"], "x": {"creator": {"name": "A B"}}}]</script><script type="application/ld+json">{bad</script>'
    assert scripts.assigned(page, "d") == {"a": {"b": 'x}"y'}}
    assert scripts.assigned("f({\"k\": 1})", "f") == {"k": 1}
    assert scripts.assigned(page, "e") is None and scripts.assigned(None, "d") is None
    assert scripts.linked_authors(page) == ["A B", "C"]
    assert scripts.balanced_json("x [1, {") is None
    assert scripts.lookup({"a": {"b": ""}, "c": 2}, "a.b", "c.d", "c") == 2


def test_publisher_xml():
    xml = '<r xmlns:ce="u"><ce:title>On <ce:italic>x</ce:italic></ce:title><ce:doi>10.1/A</ce:doi><ce:author><ce:given-name>Ann</ce:given-name><ce:surname>Doe</ce:surname></ce:author><ce:abstract><ce:simple-para>Short.</ce:simple-para></ce:abstract><ce:body><ce:sections><ce:section><ce:label>1</ce:label><ce:section-title>Intro</ce:section-title><ce:para>H<ce:inf>2</ce:inf>O</ce:para></ce:section></ce:sections></ce:body></r>'
    got = publisher_xml.article(xml)
    assert (got["title"], got["doi"], got["authors"], got["abstract"], got["markdown"]) == ("On *x*", "10.1/a", ["Ann Doe"], "Short.", "## 1 Intro\n\nH<sub>2</sub>O")
    assert publisher_xml.article("<!DOCTYPE x><x/>") is None


def test_cals():
    xml = '<t><colspec colname="a"/><colspec colname="b"/><thead><row><entry namest="a" nameend="b">H</entry></row></thead><tbody><row><entry morerows="1">1</entry><entry>2</entry></row><row><entry>3</entry></row></tbody></t>'
    got = publisher_xml.cals_grid(xml)
    assert not got["lossy"]
    assert [(c["row"], c["col"], c["text"]) for c in got["cells"]] == [(0, 0, "H"), (0, 1, "H"), (1, 0, "1"), (1, 1, "2"), (2, 0, "1"), (2, 1, "3")]
    ragged = publisher_xml.cals_grid("<t><thead><row><entry>A</entry><entry>B</entry></row></thead><tbody><row><entry>1</entry></row></tbody></t>")
    assert ragged["lossy"] and publisher_xml.lists_from_ragged(ragged["cells"]) == ["- A: 1"]


def test_language():
    assert [publisher_xml.language_hint(x) for x in ("pt-BR", "Deutsch", "", None, "not a code")] == ["pt", "de", None, None, None]


def test_abstracts():
    long = "word " * 200
    assert abstracts.distinct_blocks(["A b.", "a  B", long, long + "x", ""]) == ["A b.", long]
    assert abstracts.strip_leading(["Same text.", "Other", "Same text."], ["same text"]) == ["Other", "Same text."]
    assert not abstracts.alike("a" * 10, "a" * 90, 0.1)
