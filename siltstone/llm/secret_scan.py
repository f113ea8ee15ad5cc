"""Secret scan with a random forest that removes false positives (operator 9).

Candidates are runs of 16 or more key characters; quoted or bare values of 8 or more characters assigned to a telling
name, up to the first white space, quote or angle bracket, however long; and what stands without an assignment in a
known form: keys with a provider's prefix and JSON web tokens, tokens of an Authorization or Bearer header, passwords
in URLs, and bodies of PEM private keys, all lines as one.  A forest over each candidate's length, character classes and
transitions between them, likelihood of its letter pairs, entropy, coverage by a dictionary, path signs, neighbouring
words on both sides and known forms decides which are secrets.

The dictionary holds the whole words of a vocabulary file (`Dictionary.from_vocabulary`); the letter pairs' chances come
from the same words.

The forest learns from labelled findings: rows (before, candidate, after, label).  `example_findings` makes such rows
from a seed, for lack of a labelled table; callers may pass their own.  Training is bounded by `max_rows` rows.

Defined cases: null text is the empty text; it has no candidates.  One row per input row, so repeated rows and ties
repeat results; an empty table gives none.  Only doc_id and text are read.  Candidates are never part of the result,
only where they are and a hash of them.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batch_of, map_arrow, whole_text

#: Names that announce a secret, and names that announce something that looks like one.
TELLING = ("api", "apikey", "auth", "authorization", "bearer", "client_secret", "credential", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "token")
HARMLESS = ("build", "checksum", "commit", "digest", "etag", "example", "fingerprint", "guid", "hash", "id", "image", "integrity", "md5", "placeholder", "revision", "sha", "sha1", "sha256", "sha512", "uuid", "version")
#: Common words of names and identifiers in the made examples, and the dictionary where no vocabulary is given.
WORDS = ("access", "account", "admin", "application", "base", "build", "change", "client", "code", "config", "content", "data", "default", "demo", "document", "dummy", "error", "example", "file", "handler", "image", "index", "info", "insert", "item", "list", "main", "manager", "message", "model", "name", "node", "object", "page", "password", "path", "project", "public", "request", "response", "sample", "secret", "server", "service", "session", "source", "state", "string", "system", "table", "test", "text", "token", "type", "user", "value", "version", "your")

LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/=_\-]{{{LEAST},}}")
ASSIGNED = re.compile(r"(?i)(?:" + "|".join(sorted(TELLING, key=len, reverse=True)) + r")[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?!-----)([^\s\"'<>]{8,})")
#: Forms that need no assignment.
PROVIDER = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35}|ya29\.[A-Za-z0-9_\-.]{20,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{32,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|dop_v1_[0-9a-f]{64}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]*)*)(?![A-Za-z0-9])")
_SCHEME = r"(?:bearer|authorization[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?:basic|token|apikey|negotiate))\s+"
HEADER = re.compile(r"(?i)(?<![A-Za-z0-9_])" + _SCHEME + r"([A-Za-z0-9._~+/\-]{8,}=*)")
URL = re.compile(r"://[^\s/?#:@\"'<>]*:([^\s/?#@\"'<>]+)@")
_GAP, _LINE = r"(?:\\[rn]|\s)+", r"[A-Za-z0-9+/=]"
PEM = re.compile(rf"PRIVATE KEY(?: BLOCK)?-----{_GAP}((?:[A-Za-z][A-Za-z0-9\-]*: [^\n\\]*{_GAP})*(?:{_LINE}+(?:{_GAP}{_LINE}+)*(?=(?:{_GAP})?-----END)|{_LINE}{{16,}}(?:{_GAP}{_LINE}{{16,}})*))")
AFTER_SCHEME, AFTER_USER, AFTER_PEM = re.compile(rf"(?i){_SCHEME}$"), re.compile(r"(?:://|^)[^\s/?#:@\"'<>]*:$"), re.compile(rf"PRIVATE KEY(?: BLOCK)?-----{_GAP}$")
NEIGHBOUR = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
CONTEXT = 40
#: Kinds of characters that follow each other: small, capital, digit, other.
STEPS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (0, 3), (3, 0), (2, 3), (3, 2))
#: A file name's end behind a candidate.
EXTENSION = re.compile(r"\.[A-Za-z]{1,4}[0-9]?(?![A-Za-z0-9_])")


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order, without overlaps: of two that overlap the one that holds the other stays; a run gives what is outside them."""
    found: list[tuple[int, int]] = []
    for span in sorted((m.span(1) for form in (ASSIGNED, PROVIDER, HEADER, URL, PEM) for m in form.finditer(text)), key=lambda x: (x[0], -x[1])):
        if not found or span[0] >= found[-1][1]:
            found.append(span)
    out, k, edge = [], 0, 0
    for m in RUN.finditer(text):
        begin, end = max(m.start(), edge), m.end()
        while k < len(found) and found[k][0] < end:
            if found[k][0] - begin >= LEAST:
                out.append((begin, found[k][0]))
            edge = found[k][1]
            begin = max(begin, edge)
            out.append(found[k])
            k += 1
        if end - begin >= LEAST:
            out.append((begin, end))
    return out + found[k:]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@dataclass
class Dictionary:
    """Whole words of four letters or more, and the log chances of letter pairs in them."""

    words: frozenset[str]

    def __post_init__(self) -> None:
        pairs = Counter(p for w in self.words for p in zip(w, w[1:], strict=False))
        starts = Counter()
        for (a, _), n in pairs.items():
            starts[a] += n
        letters = string.ascii_lowercase
        # One is added to each count, so that a pair that no word has is only unlikely.
        self.pairs = {a + b: math.log((pairs[a, b] + 1) / (starts[a] + len(letters))) for a in letters for b in letters}
        self.longest = max(map(len, self.words), default=0)

    @classmethod
    def from_vocabulary(cls, path: str, end: str = "</w>", least: int = 4, most: int = 14) -> Dictionary:
        """ASCII words among a tokenizer file's entries that end a word."""
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        found = (x[: -len(end)].lower() for x in entries if x.endswith(end))
        return cls(frozenset(w for w in found if least <= len(w) <= most and w.isascii() and w.isalpha()))

    def covered(self, lowered: str) -> int:
        """Characters under words, longest first from the left."""
        n = at = 0
        while at < len(lowered):
            size = next((k for k in range(min(self.longest, len(lowered) - at), 3, -1) if lowered[at : at + k] in self.words), 0)
            n += size
            at += size or 1
        return n

    def likelihood(self, lowered: str) -> float:
        """Mean log chance of the letter pairs; 0 without any."""
        found = [self.pairs[p] for p in map("".join, zip(lowered, lowered[1:], strict=False)) if p in self.pairs]
        return sum(found) / len(found) if found else 0.0


def name_signs(text: str) -> list[float]:
    """Whether the nearest four names hold a telling and a harmless word."""
    parts = {p for w in text for p in [w, *w.split("_")]}
    return [float(any(t in parts for t in TELLING)), float(any(t in parts for t in HARMLESS))]


def features(before: str, value: str, after: str, dictionary: Dictionary) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    count = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    lowered = value.lower()
    steps = Counter(zip(kinds, kinds[1:], strict=False))
    near, behind = ([w.lower() for w in NEIGHBOUR.findall(x)] for x in (before, after))
    segments = [x for x in re.split(r"[/\\.]", lowered) if x]
    return [
        n,
        *(kinds.count(k) / n for k in range(4)),
        *(steps[a, b] / max(n - 1, 1) for a, b in STEPS),
        dictionary.likelihood(lowered),
        entropy,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        max((len(x) for x in re.findall("[A-Za-z]+", value)), default=0),
        dictionary.covered(lowered) / n,
        value.count("/"),
        sum(dictionary.covered(x) >= 0.8 * len(x) for x in segments) / max(len(segments), 1),
        float(before[-1:] in ("/", "\\", ".") or after[:1] in ("/", "\\")),
        float(bool(EXTENSION.match(after))),
        *name_signs(near[-4:]),
        name_signs(behind[:2])[1],
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != ""),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))),
        max(count.values()) / n,
        sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False)) / max(n - 1, 1),
        float(bool(PROVIDER.fullmatch(value))),
        float(bool(AFTER_SCHEME.search(before))),
        float(after[:1] == "@" and bool(AFTER_USER.search(before))),
        float(bool(AFTER_PEM.search(before))),
    ]


def example_findings(n: int = 4000, seed: int = 9) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, label) made from a seed, half secrets, half look-alikes: n with assigned values, then n without."""
    rng = random.Random(seed)
    of = lambda letters, size: "".join(rng.choice(letters) for _ in range(size))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(of("etaoinshrdlu", rng.randint(2, 9)) for _ in range(rng.randint(0, 5)))

    def jwt() -> str:
        return "eyJ" + ".".join(of(mixed + "-_", rng.randint(*size)) for size in ((15, 60), (20, 700), (43, 86)))

    def bare(lead: str, quote: str) -> tuple[str, str, str]:
        """A secret without an assignment."""
        kind = rng.randrange(4)
        if kind == 0:
            upper = string.ascii_uppercase + string.digits
            value = rng.choice([lambda: rng.choice(["AKIA", "ASIA"]) + of(upper, 16), lambda: f"gh{rng.choice('pousr')}_" + of(mixed, 36), lambda: "github_pat_" + of(mixed, 22) + "_" + of(mixed, 59), lambda: "glpat-" + of(mixed, 20), lambda: f"xox{rng.choice('bp')}-" + of(string.digits, 12) + "-" + of(mixed, 24), lambda: rng.choice(["sk_live_", "rk_live_", "sk_test_"]) + of(mixed, 24), lambda: "sk-" + of(mixed, 48), lambda: "AIza" + of(mixed + "-_", 35), lambda: "ya29." + of(mixed + "-_", 60), lambda: "npm_" + of(mixed, 36), lambda: "pypi-" + of(mixed + "-_", 150), lambda: "hf_" + of(mixed, 34), lambda: "SG." + of(mixed, 22) + "." + of(mixed, 43), lambda: "dop_v1_" + of(hexes, 64), lambda: "shpat_" + of(hexes, 32), jwt])()
            return rng.choice([f"{lead} {quote}", quote, f"{lead} ({quote}"]), value, quote + " " + prose()
        if kind == 1:
            value = rng.choice([lambda: of(mixed, rng.randint(16, 80)), lambda: of(string.ascii_letters, rng.randint(16, 64)), lambda: of(hexes, rng.choice([32, 40, 64])), lambda: of(mixed + "+/", rng.randint(12, 60)) + rng.choice(["", "=", "=="]), jwt])()
            return f"{lead} {quote}" + rng.choice(["Authorization: Bearer ", "authorization: bearer ", "Authorization: Basic ", "Authorization: token ", "Bearer "]), value, quote + " " + prose()
        if kind == 2:
            value = rng.choice([lambda: of(mixed, rng.randint(6, 32)), lambda: of(string.ascii_letters, rng.randint(8, 24)), lambda: of(mixed + "!$%^&*-_", rng.randint(6, 24)), lambda: rng.choice(WORDS) + of(string.digits + "!", rng.randint(1, 4))])()
            return f"{lead} {quote}{rng.choice(['postgres', 'https', 'mysql', 'mongodb+srv', 'amqp', 'redis', 'ftp'])}://{rng.choice(['', *WORDS])}:", value, "@" + rng.choice(WORDS)
        end = rng.choice(["\n", "\\n", " "])
        head = rng.choice(["RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", ""])
        value = end.join([*(of(mixed + "+/", 64) for _ in range(rng.randint(0, 40))), of(mixed + "+/", rng.randint(16, 64)) + rng.choice(["", "=", "=="])])
        return f"-----BEGIN {head}PRIVATE KEY-----{end}", value, rng.choice([f"{end}-----END {head}PRIVATE KEY-----", ""])

    def unlike(lead: str, quote: str) -> tuple[str, str, str, int]:
        """What only looks like one: runs of words or one character, and stand-ins in the known forms."""
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 7))]
        if rng.randrange(2):
            return f"{lead} {quote}", rng.choice([lambda: rng.choice("_-/").join(words), lambda: "".join(w.title() for w in words), lambda: rng.choice("=-_+") * rng.randint(16, 90), lambda: of(string.ascii_lowercase, rng.randint(16, 30))])(), quote + " " + prose(), 0
        stand_in = rng.choice(["x", "X", "*", "your_token_here", "access_token", "EXAMPLE", "<token>"]) * rng.randint(3, 12)
        word = rng.choice(["password", "pass", "pwd", "passwd", "secret", "user", "****", "xxxx", "...", "$PASSWORD", "${DB_PASS}", "{password}", "%s"])
        return rng.choice([(f"{lead} {quote}", rng.choice(["AKIA", "ghp_", "sk-", "sk_live_", "hf_"]) + rng.choice("xX0") * rng.randint(16, 44), quote + " " + prose(), 0), (f"{lead} {quote}Authorization: Bearer ", stand_in, quote, 0), (f"{lead} bearer ", "-".join(words[:3]), " " + prose(), 0), (f"{lead} https://{rng.choice(WORDS)}:", word, "@" + rng.choice(WORDS), 0)])

    out = []
    for k in range(2 * n):
        lead, quote = prose(), rng.choice(['"', "'", ""])
        link = rng.choice([" = ", "=", ": ", ":"])
        if k >= n:
            out.append((*bare(lead, quote), 1) if k % 2 else unlike(lead, quote))
            continue
        if k % 2:
            value = rng.choice([lambda: of(hexes, rng.choice([32, 40, 48, 64])), lambda: of(mixed, rng.randint(20, 64)), lambda: of(string.ascii_letters, rng.randint(20, 64)), lambda: of(mixed + "+/", rng.choice([40, 44, 88])) + rng.choice(["", "=", "=="]), lambda: of(mixed + "!@#%^&", rng.randint(10, 24)) + of(string.digits, 2)])()
            aside = rng.choice(["", "", f"{rng.choice(HARMLESS)}.com ", f"{rng.choice(HARMLESS)} of "])
            # A fifth of the names are none of the telling ones, so that the value itself has to tell.
            name = of(string.ascii_lowercase, rng.randint(4, 9)) + rng.choice(["", "_key"]) if rng.random() < 0.2 and len(value) >= 32 else rng.choice(["", "my_", "aws_", "db_", "x-"]) + rng.choice(TELLING)
            out.append((f"{lead} {aside}{name}{link}{quote}", value, quote + " " + prose(), 1))
            continue
        shape = rng.randrange(7)
        if shape == 0:
            out.append((f"{lead} {rng.choice(HARMLESS)}{rng.choice([' ', link])}{quote}", of(hexes, rng.choice([32, 40, 64])), quote + " " + prose(), 0))
        elif shape == 1:
            out.append((f"{lead} {rng.choice(['id', 'uuid', 'guid', 'token', 'key'])}{link}{quote}", "-".join(of(hexes, w) for w in (8, 4, 4, 4, 12)), quote + " " + prose(), 0))
        elif shape == 2:
            out.append((f"{lead} {rng.choice(['key', 'token', 'password', 'name', 'class'])}{link}{quote}", rng.choice(["_", "", "-"]).join(rng.choice(WORDS).title() for _ in range(rng.randint(2, 5))) + of(string.digits, rng.randint(0, 2)), quote + " " + prose(), 0))
        elif shape == 3:
            out.append((f"{lead} /", "/".join([*(rng.choice(WORDS) for _ in range(rng.randint(2, 5))), of(hexes, rng.choice([8, 16]))]), "/ " + prose(), 0))
        elif shape == 4:
            out.append((f"{lead} ", of(string.digits, rng.randint(16, 24)), " " + prose(), 0))
        elif shape == 5:
            out.append((f"{lead} {rng.choice(TELLING)}{link}{quote}", rng.choice(["x", "0", "*", "your_token_here_", "changeme", "1234567890abcdef", "example"]) * rng.randint(2, 8) + "xxxxxxxx", quote, 0))
        else:
            # Bare random runs: without a name, a prefix, a header, a URL or a PEM head nothing tells an identifier from a secret.
            out.append((f"{lead} ", of(rng.choice([string.ascii_lowercase, mixed]), rng.randint(16, 40)) + of(string.digits, rng.randint(1, 3)), " " + prose(), 0))
    return out


@dataclass
class Tree:
    """Arrays of a binary tree: feature (-1 in a leaf), threshold, children, share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.share[at]
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int) -> Tree:
    """One tree by Gini impurity; a split looks at `tried` random features."""
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        share = y[rows].mean()
        nodes.append([-1, 0.0, -1, -1, share])
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(rows) - least)]
            if len(cut):
                a, n, total = ones[cut - 1], len(rows), ones[-1]
                cost = a * (1 - a / cut) + (total - a) * (1 - (total - a) / (n - cut))
                k = int(np.argmin(cost))
                best = min(best, (float(cost[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][0:2] = best[1], best[2]
            nodes[me][2] = add(rows[low], level + 1)
            nodes[me][3] = add(rows[~low], level + 1)
        return me

    add(rng.integers(0, len(y), len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


@dataclass
class Forest:
    trees: list[Tree]
    dictionary: Dictionary

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def train(findings: list[tuple[str, str, str, int]] | None = None, dictionary: Dictionary | None = None, trees: int = 24, depth: int = 9, least: int = 3, max_rows: int = 20_000, seed: int = 4) -> Forest:
    """A forest from labelled findings, at most `max_rows` of them; `example_findings` without any, and a dictionary of WORDS."""
    dictionary = dictionary or Dictionary(frozenset(WORDS))
    rows = (findings if findings is not None else example_findings())[:max_rows]
    if not rows:
        raise ValueError("no labelled findings")
    x = np.array([features(b, v, a, dictionary) for b, v, a, _ in rows])
    y = np.array([label for *_, label in rows], dtype=float)
    rng = np.random.default_rng(seed)
    return Forest([grow(x, y, rng, depth, least, max(1, int(x.shape[1] ** 0.5))) for _ in range(trees)], dictionary)


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_candidates", pa.int64()), ("n_secrets", pa.int64()), ("secrets", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("sha256", pa.string())])))])
FOUND = "doc_id long, n_candidates long, n_secrets long, secrets array<struct<begin:int,end:int,score:double,sha256:string>>"


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, candidates, secrets, and the secrets' spans (code points), scores and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows, owner = [], [], []
            for i, item in enumerate(batch.column(1)):
                text = item.as_py()
                for begin, end in candidates(text):
                    rows.append(features(text[max(0, begin - CONTEXT) : begin], text[begin:end], text[end : end + CONTEXT], forest.dictionary))
                    spans.append((begin, end, hashlib.sha256(text[begin:end].encode("utf-8", "surrogatepass")).hexdigest()))
                    owner.append(i)
            score = forest(np.array(rows)) if rows else np.zeros(0)
            n, out = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for i, (begin, end, digest), p in zip(owner, spans, score, strict=True):
                n[i] += 1
                if p >= threshold:
                    out[i].append({"begin": begin, "end": end, "score": float(p), "sha256": digest})
            yield batch_of(_FOUND, [batch.column(0), n, [len(x) for x in out], out])

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")), run, FOUND)
