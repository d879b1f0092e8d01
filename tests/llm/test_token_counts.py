import random
import re

from tokenizers import Tokenizer, models

from docloom.llm import token_counts as T

from .helpers import frame, odd_texts, prose

PIECES = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -3.5), ("aba", -6.0), ("▁ab", -7.0), ("é", -2.5), ("bab", -5.5)]


def reference(pieces):
    # the unknown piece's own score stays out of the minimum that unknown characters are charged by
    return Tokenizer(models.Unigram([*pieces, ("\x00unk", 0.0)], unk_id=len(pieces), byte_fallback=False))


def test_counts_and_ties_match_the_tokenizer():
    r, tok, counter = random.Random(1), reference(PIECES), T.Counter(PIECES)
    for _ in range(3000):
        word = "▁" + "".join(r.choice("abéxy日") for _ in range(r.randint(0, 12)))
        assert counter.count(word) == len(tok.encode(word).ids), word


def test_documents(spark):
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts()] + [prose(3, 200), "ab ab\tba\nxx"]
    tok = reference(PIECES)
    out = {r.doc_id: r for r in T.token_counts(frame(spark, texts), PIECES).collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (out[k].n_words, out[k].n_tokens) == (len(words), sum(len(tok.encode("▁" + w).ids) for w in words))
    assert T.token_counts(frame(spark, []), PIECES).count() == 0


def test_public_vocabulary():
    import public_tokenizers

    pieces = T.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tok, counter = reference(pieces), T.Counter(pieces)
    for word in set(prose(9, 400).split()) | {"日本語", "ﬁn", "😀", "don't"}:
        assert counter.count("▁" + word) == len(tok.encode("▁" + word).ids), word
