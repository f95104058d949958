from collections import Counter


def brute_spans(rows, m):
    """Texts by id without the bytes that repeated strings of m bytes cover."""
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + m] for _, b in data for k in range(len(b) - m + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - m + 1):
            if n[b[k : k + m]] > 1:
                gone[k : k + m] = b"\1" * m
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
    return out
