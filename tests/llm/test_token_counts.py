import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerlens.llm.token_counts import token_counts, word_pieces
from ledgerlens.llm.tries import longest_match


def brute(word, first, later):
    n, i = 0, 0
    while i < len(word):
        have = first if i == 0 else later
        j = next((j for j in range(len(word), i, -1) if word[i:j] in have), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


pieces = st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=14)


@settings(max_examples=150, deadline=None)
@given(pieces, pieces, st.lists(st.text("abcd", max_size=14).map(str.encode), max_size=20))
def test_automaton_against_brute_force(first, later, words):
    assert longest_match(first, later).counts(words).tolist() == [brute(w, first, later) for w in words]


def test_public_vocabulary_against_a_word_piece_library(spark, documents):
    first, later = word_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    vocab = {"[UNK]": 0}
    for p in [x.decode() for x in first] + ["##" + x.decode() for x in later]:
        vocab.setdefault(p, len(vocab))
    t = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    r = random.Random(2)
    texts = [" ".join("".join(r.choices(["the", "tion", "é", "ß", "日", "ing", "X", ",", "q́", "😀"], k=r.randrange(1, 7))) for _ in range(40)) for _ in range(30)]
    rows = list(enumerate([*texts, "", None, "  ", "x" * 5000])) + [(None, "the tion"), (3, texts[3])]
    got = token_counts(documents(rows), first, later).collect()
    expected = sorted((-1 if i is None else i, len((x or "").split()), len(t.encode(x or "").ids)) for i, x in rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_words, g.n_tokens) for g in got) == expected
    assert token_counts(documents(rows).limit(0), first, later).count() == 0
