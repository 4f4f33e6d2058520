from panelspark.llm import cross_parse as c
from panelspark.llm import queries

SF = "/root/testdata/sf0.01"


def phrases(word, words):
    text, n, i = "|".join(words), 0, 0
    while i < len(word):
        j = i
        while j < len(word) and word[i : j + 1] in text:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_automaton_parses_like_substring_search():
    words = ["banana", "bandana", "an", "nab", "cab", "abacus", "éa"]
    a = c.SuffixAutomaton(words)
    for w in ["", "b", "x", "banx", "xx", "nabandan", "abacab", "bananaéax", "naaan", "cabacusq"]:
        assert a.phrases(w) == phrases(w, words), w


def test_held_out_texts_are_recognised(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, SF)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(docs, "doc_id")
    assert held.filter("lang_pred = lang").count() > 0.97 * held.count()
    assert got.filter("score < 0 or score > 1").isEmpty()


def test_edges(edges, given, empty):
    got = c.identify(edges, given).collect()
    assert len(got) == edges.count()
    for r in got:
        if not any(ch.isalpha() for ch in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en", "es", "fr") and 0 < r["score"] <= 1
        assert r["digest"] == "mine"
    assert {r["lang_pred"] for r in c.identify(edges, empty).collect()} == {"und"}
    assert c.identify(empty, given).count() == 0


def test_unlabelled_rows_teach_nothing(spark):
    labelled = spark.createDataFrame([(1, "aaa bbb", "x"), (2, None, "y"), (3, "ccc", None), (None, "zzz yyy", "z")], "doc_id bigint, text string, lang string")
    assert [lang for lang, _ in c.samples(labelled)] == ["x"]


def test_words_are_taken_from_whole_texts_by_frequency(spark, monkeypatch):
    tail = "filler " * 10_000 + "alpha " * 3 + "beta " * 2 + "gamma"
    labelled = spark.createDataFrame([(1, tail, "x"), (1, tail, "x"), (2, "one two two", "y"), (3, "12 34", "z")], "doc_id bigint, text string, lang string")
    assert c.samples(labelled) == (("x", ("filler", "alpha", "beta", "gamma")), ("y", ("two", "one")))
    monkeypatch.setattr(c, "SAMPLE_LETTERS", 24)
    assert c.samples(labelled) == (("x", ("filler", "alpha")), ("y", ("two", "one")))


def plain_judge(text, samples):
    """The cheapest language by substring search alone."""
    top = max(round(16 * c.math.log2(max(2, sum(map(len, words))))) for _, words in samples)
    best = None
    for name, words in samples:
        bits, cost = round(16 * c.math.log2(max(2, sum(map(len, words))))), 0
        for w in c.letters(text):
            cost += phrases(w, words) * bits + sum(not any(ch in x for x in words) for ch in w) * (top - bits)
        best = min(best or (cost, name), (cost, name))
    return best[1]


def test_the_choice_is_that_of_a_plain_parse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = tuple((name, words[:300]) for name, words in c.samples(docs))
    judge = c.Parser(known).judge
    for r in docs.orderBy("doc_id").limit(60).collect():
        if c.letters(r["text"] or ""):
            assert judge(r["text"])[0] == plain_judge(r["text"], known), r["doc_id"]


def test_a_language_of_one_word_does_not_win():
    english = tuple("the quick brown fox jumps over lazy dog and some other words of english that make a sample large enough".split())
    judge = c.Parser((("en", english), ("tiny", ("aaa",)))).judge
    assert judge("the words of the dog")[0] == "en" and judge("aaa aaa")[0] == "tiny"
