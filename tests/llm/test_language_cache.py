from panelspark.llm import cross_parse as c


def test_frequent_words_stay_known(monkeypatch):
    """A word that comes back all the time is parsed once, however many rare ones fill the table."""
    monkeypatch.setattr(c, "KEPT_WORDS", 8)
    parser = c.Parser((("x", ("often", "seldom")),))
    parsed = []
    monkeypatch.setattr(parser.automata[0], "phrases", lambda word: parsed.append(word) or 1)
    for i in range(200):
        parser.judge("often " + "rare" + "abcdefghij"[i % 10] * (i // 10 + 1))
        assert len(parser) + len(parser.older) <= 8
    assert parsed.count("often") == 1 and len(parsed) == 201
