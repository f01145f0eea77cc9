"""Secret scan: base patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are maximal runs of [A-Za-z0-9+/_.=-].  Each is outside (O), the beginning (B) or the inside (I) of a secret.
Three kinds of tokens can be other than O, a hard constraint of the model: those of MIN_CHARS or more with a letter and a digit,
those of LONG_CHARS or more whose case changes within, and those of NAMED_CHARS or more, whatever their letters, right
behind a word that names secrets.  As all others fix the state, Viterbi decoding of a text falls apart into independent
runs of candidates, which gives the same best path as decoding every token.

Features: the token's shape, the words and signs next to it, and features of the whole file.  The field is fitted by
maximum likelihood (gradient steps on the forward-backward expectations) on a bounded sample: SAMPLE_TEXTS texts in
the order of their hash, at most SAMPLE_CHARS of each, labelled by the base patterns, and seeded artificial secrets put into those texts.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, below_share, texts_of
from .spans import digest, joined, overlaps

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

MIN_CHARS, LONG_CHARS, NAMED_CHARS = 10, 16, 6
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 4000
#: Tokens after which a run of the sample is cut in two for fitting.
LONGEST_RUN = 8
STATES = ("O", "B", "I")
#: Tokens of MIN_CHARS or more with a digit and a letter, and of LONG_CHARS or more with a small letter before a capital one.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{10,}|(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_.=-]*[a-z][A-Z])[A-Za-z0-9+/_.=-]{16,}")
NAMES = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "private", "access", "api")
#: A word that names secrets, what may stand between, and a token.
NAMED = re.compile(rf"(?:{'|'.join(NAMES)})\w*[\"']?(?:\x20+(?:is|was))?\x20*[:=]?\x20*[\"']?(?<![A-Za-z0-9+/_.=-])([A-Za-z0-9+/_.=-]{{6,}})", re.IGNORECASE | re.ASCII)
BETWEEN = re.compile(r"\b(?:is|was)\x20+\Z", re.IGNORECASE)
BEFORE = re.compile(r"([\w-]*)([\"']?\x20*[:=]?\x20*[\"']?)\Z")
N_FEATURES = 40


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def file_features(text: str) -> list[int]:
    """Of the file: much punctuation of code, assignments in it, lines that end like code."""
    n = max(1, len(text))
    signs = sum(map(text.count, "{}()[];=<>"))
    return [k for k, on in ((34, signs * 50 > n), (35, "=" in text), (36, ";\n" in text or "{\n" in text)) if on]


def features(text: str, start: int, end: int, of_file: list[int]) -> list[int]:
    """Numbers of the binary features that hold."""
    token = text[start:end]
    n, counts = len(token), Counter(token)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digit = sum(map(token.count, "0123456789")) / n
    upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
    words = [w for w in re.split(r"[+/_.=-]+", token) if w]
    low = max(0, start - 60)
    said = BETWEEN.search(text, low, start)
    m = BEFORE.search(text, low, said.start() if said else start)
    word, sign = m[1].lower(), m[2]
    after = text[end : end + 1]
    on = [0, *of_file]
    on.append(1 + min(4, max(0, n - MIN_CHARS) // 6))  # 1 to 5: length
    on.append(6 + min(4, int(max(0.0, entropy - 2) * 2)))  # 6 to 10: entropy
    on.append(11 + min(3, int(digit * 4)))  # 11 to 14: digits
    for k, cond in (
        (15, upper and lower),
        (16, upper and not lower),
        (17, lower and not upper),
        (18, not set(token) - set("0123456789abcdef")),
        (19, any(c in token for c in "+/=")),
        (20, "." in token),
        (21, "_" in token or "-" in token),
        (22, max(map(len, words), default=0) < 8),
        (23, token.count("/") > 1),
        (24, "=" in sign or ":" in sign),
        (25, '"' in sign or "'" in sign),
        (26, after in ("\"", "'")),
        (27, any(w in word for w in NAMES)),
        (28, token[0].isdigit()),
        (29, bool(re.match(r"[a-z]+[0-9]{1,4}\Z", token, re.IGNORECASE))),
        (30, bool(re.match(r"[0-9.,/-]+[A-Za-z]{0,3}\Z", token))),
        (31, sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False)) >= 5),
        (32, start == 0 or text[start - 1] in "\n"),
        (33, after in ("", "\n")),
        (37, bool(said)),
        (38, not set(token) & set("0123456789")),
        (39, n < MIN_CHARS),
    ):
        if cond:
            on.append(k)
    return on


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Candidates, in runs with nothing but spaces or one line break between them."""
    out: list[list[tuple[int, int]]] = []
    for a, b in sorted({m.span() for m in CANDIDATE.finditer(text)} | {m.span(1) for m in NAMED.finditer(text)}):
        if out and text[out[-1][-1][1] : a].strip(" ") in ("", "\n"):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def viterbi(emission: np.ndarray, model: dict) -> list[int]:
    """The best states of a run between two O tokens."""
    best, back = model["into"] + emission[0], []
    for e in emission[1:]:
        scores = best[:, None] + model["move"]
        back.append(scores.argmax(0))
        best = scores.max(0) + e
    k = int((best + model["out"]).argmax())
    path = [k]
    for b in reversed(back):
        k = int(b[k])
        path.append(k)
    return path[::-1]


def found_by_field(text: str, model: dict) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    of_file = None
    for run in runs(text):
        of_file = file_features(text) if of_file is None else of_file
        emission = np.array([model["weights"][features(text, a, b, of_file)].sum(0) for a, b in run])
        for (a, b), s in zip(run, viterbi(emission, model), strict=True):
            if STATES[s] == "B":
                out.append(("secret", a, b))
            elif STATES[s] == "I" and out:
                out[-1] = ("secret", out[-1][1], b)
    return out


def find(text: str, model: dict) -> list[tuple[str, int, int]]:
    """Base spans and, where they leave room, the field's, by start and kind."""
    base = base_spans(text)
    more = [s for s in found_by_field(text, model) if not overlaps(s[1:], [b[1:] for b in base])]
    order = (*KINDS, "secret")
    return sorted(base + more, key=lambda s: (s[1], order.index(s[0])))


def examples(texts: list[str], seed: int = 7) -> list[tuple[list[list[int]], list[int]]]:
    """Runs as (features of each token, states): from the texts as they are, and with secrets and harmless codes put in."""
    rng, out = random.Random(seed), []
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-")

    def add(text: str, secret: list[tuple[int, int]]) -> None:
        of_file = file_features(text)
        for run in runs(text):
            states, open_ = [], False
            for a, b in run:
                inside = overlaps((a, b), secret)
                joined_ = inside and open_ and any(x <= a - 1 and b <= y and x < a for x, y in secret)
                states.append(2 if joined_ else 1 if inside else 0)
                open_ = inside
            out.append(([features(text, a, b, of_file) for a, b in run], states))

    for text in texts:
        add(text, [s[1:] for s in base_spans(text)])
        for secret in (True, True, False, None):
            at = rng.randrange(len(text) + 1)
            at = text.rfind(" ", 0, at) + 1
            if secret:
                letters = rng.choice(alphabets)
                token = rng.choice(("", "", "ghp_", "sk-", "xoxb-", "AIza")) + "".join(rng.choice(letters) for _ in range(rng.choice((20, 24, 32, 40, 64))))
                lead = rng.choice(("", "", "key = ", 'auth: "', "Bearer ", "private_key=", "access key "))
                if rng.random() < 0.3:  # short ones, and ones of letters alone, behind a name
                    token = "".join(rng.choice(rng.choice(alphabets[2:])) for _ in range(rng.choice((6, 7, 8, 9)))) if rng.random() < 0.5 else "".join(rng.choice(alphabets[2][:52]) for _ in range(rng.choice((12, 16, 24, 32))))
                    lead = rng.choice(("key = ", "pwd: ", 'auth: "', "Bearer ", "credential=", "access key: ", "passwd is ", "pwd "))
                if not CANDIDATE.fullmatch(token) and not NAMED.fullmatch(lead + token):
                    continue
            elif secret is None:  # plain words behind a name
                token = rng.choice([w for w in re.findall(r"[A-Za-z]{6,}", text[:2000])] or ["features"])
                lead = rng.choice(("the key ", "secret ", "access ", "a token ", "private ", "api ", "author ", "key: ", "the password is "))
            else:
                token = rng.choice(("2023-01-{}T10-{}", "version-{}.{}.1-beta", "chapter{}section{}", "item-{}/part-{}", "model{}series{}x", "abcdefgh{}{}")).format(rng.randrange(9, 99), rng.randrange(9, 99))
                if rng.random() < 0.5:  # words of the text itself, joined as in paths and names
                    own = [w for w in re.findall(r"[A-Za-z]+", text[:2000]) if len(w) > 2] or ["page"]
                    token = rng.choice("-/_.").join(rng.choice(own) for _ in range(rng.randrange(2, 6))) + rng.choice(("-{}", "/{}", "_v{}", ".{}", "{}")).format(rng.randrange(1, 2100))
                lead = rng.choice(("", "", "see ", "page: "))
            put = f"{lead}{token}" + ('"' if lead.endswith('"') else "")
            new = text[:at] + put + " " + text[at:]
            a = at + len(lead)
            window = new[max(0, a - 300) : a + len(token) + 300]
            a -= max(0, a - 300)
            add(window, [(a, a + len(token))] if secret else [s[1:] for s in base_spans(window)])
            if secret and rng.random() < 0.3:  # one secret broken over two lines
                half = len(token) // 2
                broken = window[: a + half] + "\n" + window[a + half :]
                add(broken, [(a, a + len(token) + 1)])
    return [(tokens[k : k + LONGEST_RUN], states[k : k + LONGEST_RUN]) for tokens, states in out for k in range(0, len(tokens), LONGEST_RUN)]


def fit(texts: list[str], steps: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> dict:
    """Maximum likelihood by Adam over all examples, padded to one length; deterministic."""
    data = examples(texts)
    if not data:
        data = examples(["a plain text with some words in it and nothing else to see here"] * 40)
    n, length = len(data), max(len(x) for x, _ in data)
    x, y, mask = np.zeros((n, length, N_FEATURES)), np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (tokens, states) in enumerate(data):
        for j, on in enumerate(tokens):
            x[i, j, on] = 1
        y[i, : len(states)], mask[i, : len(states)] = states, True
    last = mask.sum(1) - 1
    p = {"weights": np.zeros((N_FEATURES, 3)), "into": np.zeros(3), "move": np.zeros((3, 3)), "out": np.zeros(3)}
    p["into"][2] = p["move"][0, 2] = -30.0  # I follows B or I only
    one, rows = np.eye(3), np.arange(n)
    lse = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        e = x @ p["weights"]
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = p["into"] + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + p["move"], 1) + e[:, t]
        beta[rows, last] = p["out"]
        for t in range(length - 2, -1, -1):
            b = lse(p["move"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < last)[:, None], b, beta[:, t])
        z = lse(alpha[:, 0] + beta[:, 0], 1)
        gamma = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        delta = one[y] * mask[..., None] - gamma
        g = {"weights": np.einsum("ntf,nts->fs", x, delta), "into": delta[:, 0].sum(0), "out": delta[rows, last].sum(0), "move": np.zeros((3, 3))}
        for t in range(1, length):
            on = mask[:, t]
            if on.any():
                xi = np.exp(alpha[on, t - 1, :, None] + p["move"] + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
                g["move"] += np.einsum("ni,nj->ij", one[y[on, t - 1]], one[y[on, t]]) - xi.sum(0)
        for k, v in p.items():
            d = g[k] / n - penalty * v
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * d, 0.999 * m2[k] + 0.001 * d * d
            v += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        p["into"][2] = p["move"][0, 2] = -30.0
    return p


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_TEXTS) -> dict:
    """Fit on sample texts, half of them with a candidate or base pattern in them (as far as there are), by the order of their hash.

    Only rows under a hash threshold, about 20 times as many as the sample, are looked at, so what is sorted and sent is bounded.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = below_share(rows.withColumn("h", F.xxhash64("k", "text")), 20 * sample / max(1, docs.count()), "h").withColumn("t", F.substring("text", 1, SAMPLE_CHARS))
    marked = rows.where(F.col("t").rlike(r"[0-9a-f]{24}|AKIA|[A-Za-z]+[0-9]+[A-Za-z]+[0-9]+"))
    texts = [r.t for part in (marked, rows) for r in part.select("t", "h", "k").orderBy("h", "k", "t").limit(sample // 2).collect()]
    return fit(texts)


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of whole texts, in code points, end exclusive.

    Null and empty texts have no spans.  Row for row, without a shuffle; repeated rows stay, further columns are dropped.
    """

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "spans": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t, model)] for t in texts_of(batch)]}

    return arrow_map(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest_scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: counts and digests of what find() gives."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in texts_of(batch):
            found = find(t, model)
            base = [s for s in found if s[0] in KINDS]
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(found))
        return {"doc_id": batch.column(0), **out}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
