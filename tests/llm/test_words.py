import random

from panelspark.llm import chosen_path, suffix_dedup, words


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def flipped(text):
    return text.translate(str.maketrans("ab", "ba"))


def test_words_of_the_same_parts_differ():
    for n in (64, 512, 1024, 2048, 4096, 1 << 15):
        a = thue_morse(n)
        h = words.words_of([a.encode(), flipped(a).encode()]).hashes
        assert len(h) == 2 and h[0] != h[1]


def test_hash_follows_the_word_only():
    rnd = random.Random(3)
    kinds = ["".join(rnd.choice("abcé漢") for _ in range(rnd.choice([1, 2, 5, 63, 64, 65, 200]))) for _ in range(300)]
    texts = [" ".join(rnd.choice(kinds) for _ in range(rnd.randint(0, 40))) for _ in range(100)]
    found = words.words_of([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        own = found.hashes[found.first[i] : found.first[i + 1]]
        assert len(own) == len(t.split())
        for word, h in zip(t.split(), own.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_unlike_texts_are_not_linked(spark):
    a = thue_morse(4096)
    df = spark.createDataFrame([(1, a), (2, flipped(a)), (3, a)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_groups(df, size=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_strings_of_one_hash_are_one_string():
    a = thue_morse(1 << 14)
    content = {}
    for raw in (a.encode(), flipped(a).encode(), a[77:].encode(), b"x" * 9000, b"xy" * 4000):
        _, string, first, last, _ = suffix_dedup.super_windows(raw)
        for s, i, j in zip(string.tolist(), first.tolist(), last.tolist()):
            assert content.setdefault(s, raw[i : j + suffix_dedup.LENGTH]) == raw[i : j + suffix_dedup.LENGTH]
    assert len(set(content.values())) == len(content)
