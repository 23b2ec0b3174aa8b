"""The operators' results worked out in plain Python, for small inputs."""

import hashlib
import os
import re

import numpy as np
import public_tokenizers
from pyspark.sql import types as T

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")
KINDS = {"doc_id": T.LongType(), "text": T.StringType(), "lang": T.StringType(), "source": T.StringType(), "n_chars": T.LongType()}
DOCS = T.StructType([T.StructField(name, kind) for name, kind in KINDS.items()])


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, lower(text))


def windows(item, size):
    w = words(item)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def contamination(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        for window in windows(item, size):
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(name)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def line_dedup(docs, window=2, long_words=20):
    """docs: (doc_id, text) in order of doc_id, all different. Gives the texts left."""
    seen, left, alone = set(), [], set()
    gone = []
    for _, text in docs:
        ls = [] if text is None else text.split("\n")
        out = set()
        for i in range(len(ls) - window + 1):
            w = tuple(ls[i : i + window])
            if w in seen and any(w):
                out.update(range(i, i + window))
            seen.add(w)
        for i, line in enumerate(ls):
            if long_words is not None and len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= long_words:
                if line in alone:
                    out.add(i)
                alone.add(line)
        gone.append((ls, out))
    for (_, text), (ls, out) in zip(docs, gone, strict=True):
        left.append(None if text is None else "\n".join(x for i, x in enumerate(ls) if i not in out))
    return left


def substring_dedup(docs, size=50):
    """docs: (doc_id, text). Gives (bytes left, removed, spans)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), int(gone.sum()), spans))
    return out


def shingles(text, width):
    w = words(text, r"[^\x20\x09-\x0D]+")
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def jaccard_components(docs, width=4, share=85):
    """docs: (doc_id, text). Gives (size, component) for each."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= share * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (name, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]
