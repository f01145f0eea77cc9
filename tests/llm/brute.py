"""Plain versions of the operators, for a driver that has all rows, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def white_words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def token_files(docs: list[tuple], path: str) -> list[tuple]:
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def ranks(path: str) -> dict[bytes, int]:
    import base64

    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}


def byte_pairs(docs: list[tuple], path: str, pattern: str) -> list[tuple]:
    import tiktoken

    e, out = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}), []
    for doc_id, text in docs:
        ids = e.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha((text or "").encode())))
    return out


def secret_base(text: str | None) -> list[tuple]:
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def personal_base(text: str | None) -> list[tuple]:
    text = text or ""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d: list[int]) -> bool:
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingle_set(text: str | None, words: int) -> frozenset:
    w = white_words((text or "").translate(LOWER))
    n = min(words, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def jaccard_components(docs: list[tuple], percent: int, words: int) -> list[tuple]:
    sets = [shingle_set(t, words) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)]


def without_repeats(docs: list[tuple], window: int = 35) -> list[tuple]:
    words = [white_words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def texts_by_rules(docs: list[tuple], max_docs: int = 100) -> list[str | None]:
    """The texts of (doc_id, text, host) without the lines over the limit."""
    holders: dict[tuple, dict] = {}
    for doc_id, text, host in docs:
        for line in (text or "").split("\n"):
            if white_words(line):
                at = holders.setdefault((host, normal(line)), {})
                at[text] = min(at.get(text, doc_id), doc_id)
    first = {k: min(v.values()) for k, v in holders.items() if len(v) > max_docs}
    out = []
    for doc_id, text, host in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not white_words(x) or first.get((host, normal(x)), doc_id) == doc_id]
        out.append(text if len(kept) == len(lines) else "\n".join(kept))
    return out


def normal(line: str) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def kept_by_rules(docs: list[tuple], max_docs: int = 100, max_removed: int = 70) -> list[tuple]:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of (doc_id, text, host)."""
    holders: dict[tuple, dict] = {}
    for doc_id, text, host in docs:
        for line in {normal(x) for x in (text or "").split("\n") if white_words(x)}:
            at = holders.setdefault((host, line), {})
            at[text] = min(at.get(text, doc_id), doc_id)
    frequent = {k: min(v.values()) for k, v in holders.items() if len(v) > max_docs}
    out = []
    for doc_id, text, host in docs:
        w, lines = white_words(text), [x for x in (text or "").split("\n") if white_words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(grams)
        again = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)}
        removed = sum(len(white_words(normal(x))) for x in lines if frequent.get((host, normal(x)), doc_id) != doc_id)
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed, not failed and 100 * removed <= max_removed * len(w)))
    return out
