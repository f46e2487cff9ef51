"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def suffix(docs, window=100):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(part)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def repeats(docs, window=50):
    """docs: [(doc_id, text)] -> {doc_id: (n_words, n_removed, kept)}."""
    seen, out = {}, {}
    split = {doc: (text or "").encode().split() for doc, text in docs}
    for doc, words in split.items():
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            seen[key] = min(seen.get(key, doc), doc)
    for doc, words in split.items():
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out[doc] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def sha256(data):
    return hashlib.sha256(data).hexdigest()
