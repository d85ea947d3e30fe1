import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from threadloom.llm import wordpiece as wp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(begin, go_on, word):
    out, at, vocab = 0, 0, set(begin)
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocab), None)
        if end is None:
            return 0
        at, out, vocab = end, out + 1, set(go_on)
    return out


words = st.lists(st.text("ab", min_size=1, max_size=4), max_size=8)


@settings(max_examples=500, deadline=None)
@given(words, words, st.text("abc", min_size=1, max_size=12))
def test_equals_greedy(begin, go_on, word):
    enc = lambda x: [w.encode() for w in x]
    assert wp.LongestMatch(enc(begin), enc(go_on)).count(word.encode()) == greedy(enc(begin), enc(go_on), word.encode())


def test_equals_library():
    rnd = random.Random(4)
    begin = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) for _ in range(120)})
    go_on = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4))) for _ in range(60)})
    vocab = {v: i for i, v in enumerate(["[UNK]", *begin, *("##" + g for g in go_on)])}
    library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    counter = wp.Counter(wp.LongestMatch([b.encode() for b in begin], [g.encode() for g in go_on]), longest=100)
    for _ in range(400):
        text = "".join(rnd.choice("abcde \n \x85") for _ in range(rnd.randint(0, 60))) + rnd.choice(["", " " + "a" * 101, " z"])
        assert counter.text(text)[1] == len(library.encode(text).ids), text


def test_rows(spark):
    texts = {1: "the quick brown fox", 2: None, 3: "", 4: "über 漢字  x " * 3000, 5: "\x1c \x1d", 6: "QmFzZTY0" * 400 + " end", 7: "a" * 5000}
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts.items()] + [(1, texts[1], 9), (None, "a", 9)], "doc_id long, text string, n_tokens int")
    begin, go_on = map(set, wp.vocabulary(PATH))
    got = sorted(map(tuple, wp.token_counts(docs, PATH).collect()), key=str)
    want = []
    for i, t in [*texts.items(), (1, texts[1]), (None, "a")]:
        own = wp.WORDS.findall(t or "")
        cache = {w: greedy(begin, go_on, w.encode()) or 1 for w in set(own)}
        want.append((i, len(own), sum(cache[w] for w in own)))
    assert got == sorted(want, key=str)
    assert wp.token_counts(docs.limit(0), PATH).count() == 0
