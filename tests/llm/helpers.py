"""Small documents with every odd case, and plain versions of what operators compute."""

import hashlib
import random
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, spans string, n long"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def prose(seed, n):
    r = random.Random(seed)
    stems = ["an", "ber", "cro", "del", "eth", "fur", "gan", "hol", "int", "jor", "kel", "lum", "é", "ß", "ñ"]
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def frame(spark, texts, first=0, **columns):
    """Rows from texts or (doc_id, text) pairs, with extra columns whose names operators use inside."""
    rows = []
    for k, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (first + k, t)
        rows.append((doc_id, text, columns.get("lang"), columns.get("source", f"s{k % 3}"), len(text) if text else None, "x", "y", "z", 1))
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    """Null, empty, blank, punctuation only, one word, very long, control characters, repeated rows."""
    return [None, "", "   \n\t ", "!!! ---", "word", "Ünï çödé 😀 日本語", prose(1, 20_000), "a\x1fb \x00 c\x0bd", "same text here", "same text here", (8, "same text here"), (None, "id is null")]


def components(sets, percent=85):
    """Smallest index reachable over links of similar sets."""
    n = len(sets)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
