"""Plain restatements of what operators return, for small inputs."""

import hashlib
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_strings(docs, length=100):
    """docs: (doc_id, text), ids unique. doc_id -> (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def repeated_windows(docs, length=50):
    seen, out = {}, {}
    for doc, text in sorted(docs):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if seen.setdefault(w, doc) < doc:
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc] = (len(words), sum(gone), sha(" ".join(kept).encode()))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_classes(docs, least=0.8):
    """docs: (doc_id, text). doc_id -> smallest id of its class, by comparing all pairs."""
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, ta) in enumerate(docs):
        for b, tb in docs[:i]:
            wa, wb = WORDS.findall(ta or ""), WORDS.findall(tb or "")
            same = (ta or "") == (tb or "")
            if same or wa and wb and distance(wa, wb) <= (1 - least) * max(len(wa), len(wb)) + 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in docs}


def base_secrets(text):
    out = []
    for kind, pattern, group, least in (("assign", r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    words = WORDS.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    gone = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(gone), n < 20 or 100 * len(gone) > 30 * n


def middle(doc, text, seed=42, cut=50, suffix_first=80):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digest = len(units), sha(f"{seed}:{'' if doc is None else doc}".encode())
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def runs(words, times=4, least=6):
    """(start, length, smallest period) of every run, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= times * q and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return [(i, j - i, q) for (i, j), q in sorted(found.items()) if j - i >= max(least, times * q)]


def planted(doc, text):
    words, h = WORDS.findall(text or ""), zlib.crc32(("" if doc is None else str(doc)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periodic(doc, text):
    """The row of op12 without its id."""
    words = planted(doc, text)
    found = runs(words)
    gone = {k for i, n, q in found for k in range(i + q, i + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{i},{n},{q}\n" for i, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *shown, sha(lines.encode()), sha(" ".join(w for k, w in enumerate(words) if k not in gone).encode())
