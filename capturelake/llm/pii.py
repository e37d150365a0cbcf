"""Personal data with a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers in the whole text. Tokens that could be
personal data (they hold a digit or '@') are the nodes of a factor graph: chain edges join neighbouring tokens, skip edges
join tokens of the same or similar form anywhere in the document, through a hub (so edges grow with the tokens, not with their
pairs). What repeats share, their form, speaks once, at the hub of the same form; what stands before each speaks at each.
Loopy sum-product passing over all graphs of a batch gives marginals; tokens that the patterns left out become spans of their
likeliest label where that has a probability of ``MIN_PROBABILITY`` or more (in one of a run of neighbours). Secrets (keys,
tokens, passwords) are a kind that only the field finds.

Training: node weights by likelihood, edge weights by pseudo-likelihood, on at most ``TRAIN_DOCS`` documents that hold such tokens and
``TRAIN_TOKENS`` tokens of whole documents, with the patterns' spans and the values of assignments such as ``token = "..."``
as labels but without features that copy the patterns. Repeats of a labelled token have its label in training: most show
nothing of it themselves, so it is skip edges that find them. Node weights are learned from all that speaks for a form, edge
weights by the likelihood of each label given its neighbours'. Only token features and labels reach the driver.

Defined cases: null and empty texts have no spans; equal documents give equal spans; null ids are kept; ties between labels go to
the first kind; with no token to learn from only the patterns' spans are found; an empty table gives no rows; texts are read
whole, in time linear in their length."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import arrow_rows, materialize, release, table, text_chunks

#: The patterns' kinds, and one that only the field finds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
TRAIN_DOCS, TRAIN_TOKENS, MIN_PROBABILITY = 4000, 40_000, 0.9
REPEAT = 6  # letters and digits from which on equal tokens are one thing; shorter ones are similar only
SAME = 8.0  # what tokens of one form are given for equal labels, before training
ROUNDS, TOLERANCE = 60, 1e-3  # message passing ends when no message changes by more, and in any case after so many rounds
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Assignments whose values the field learns as secrets; it finds others by their form and by what stands before them.
_SECRET = re.compile(r"\b(?:token|secret|passw(?:or)?d|api[_-]?key|key)\b[\"']?\s*+[=:]\s*+[\"']?([A-Za-z0-9+/_-]{16,})", re.I)
_DIGIT = re.compile(r"[0-9]")
_NODE = re.compile(r"\S*[0-9@]\S*")
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.S)
_WORD = re.compile(r"[a-z]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                end = m.end()
                out.append((start, end, 0))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and _luhn(d):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


class Graph:
    """Tokens of one document: spans, features, labels by the patterns (0: none), and edges by kind (0 chain, 1 similar form, 2
    same form).

    Tokens of one form are joined to a hub, a node without a span, so that a label is two steps away however many they are; two
    of a similar form are joined directly. ``learn`` has the labels to train on: those of the patterns and of assignments of
    secrets, and for the hub and all tokens of a form what most of its labelled tokens have."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, self.features, self.labels = [], [], []
        begins = [b[0] for b in base]
        secrets = [(m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
        keys: list[str] = []
        for m in _NODE.finditer(text):
            core = _CORE.search(m[0])
            if not core:
                continue
            s, e = m.start() + core.start(), m.start() + core.end()
            token = text[s:e]
            before = _WORD.findall(text[max(0, s - 24) : s].lower())
            keys.append(re.sub(r"[^0-9a-z@]", "", token.lower()))
            self.spans.append((s, e))
            self.features.append(shape(token, before[-1] if before else ""))
            i = bisect.bisect_right(begins, e - 1)
            near = [b for b in base[max(0, i - 4) : i] if b[0] < e and s < b[1]]
            self.labels.append(near[0][2] + 1 if near else 0)
        self.edges = [(i, i + 1, 0) for i in range(len(keys) - 1) if self.spans[i + 1][0] - self.spans[i][1] <= 3]
        self.learn = list(self.labels)
        at = 0
        for i, (s, e) in enumerate(self.spans):
            while at < len(secrets) and secrets[at][1] <= s:
                at += 1
            if not self.learn[i] and at < len(secrets) and secrets[at][0] < e:
                self.learn[i] = len(KINDS)
        same: dict[str, list[int]] = {}
        similar: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            if len(k) >= REPEAT:
                same.setdefault(k, []).append(i)
            else:
                similar.setdefault(k, []).append(i)
        for k, members in same.items():
            first = members[0]
            if len(members) > 1:
                first = self._hub(members, 2, [f for f in self.features[first] if not f.startswith("before:")])
                for i in members:
                    self.learn[i] = self.learn[first]
                    self.features[i] = [f for f in self.features[i] if f.startswith("before:") and f != BARE]
            similar.setdefault(k[:8] + "|" + str(len(k)), []).append(first)  # of one length and beginning
        for members in similar.values():
            if len(members) == 2:
                self.edges.append((*members, 1))
            elif len(members) > 2:
                self._hub(members, 1, [])
        self.edges.sort()

    def _hub(self, members: list[int], kind: int, features: list[str]) -> int:
        """A node without a span, joined to members."""
        hub = len(self.features)
        own = [y for i in members if (y := self.learn[i])]
        self.features.append(features)
        self.labels.append(0)
        self.learn.append(max(sorted(set(own)), key=own.count) if own else 0)
        self.edges += [(i, hub, kind) for i in members]
        return hub

    def added(self, p: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """Runs of tokens, one character apart, that the patterns left out and that share a likely label."""
        tokens = len(self.spans)
        label, out, sure = p[:tokens].argmax(1), [], 0.0
        before = -1
        for n in np.flatnonzero((label > 0) & (np.array(self.labels[:tokens]) == 0)).tolist():
            s, e = self.spans[n]
            kind, chance = int(label[n]) - 1, float(p[n, label[n]])
            if out and before == n - 1 and out[-1][2] == kind and s - out[-1][1] <= 1:
                out[-1], sure = (out[-1][0], e, kind, False), max(sure, chance)
            else:
                if out and sure < MIN_PROBABILITY:
                    out.pop()
                out.append((s, e, kind, False))
                sure = chance
            before = n
        if out and sure < MIN_PROBABILITY:
            out.pop()
        return out


def shape(token: str, before: str) -> list[str]:
    digits = len(_DIGIT.findall(token))
    letters = sum(c.isalpha() for c in token)
    groups = [len(g) for g in re.findall(r"[0-9]+", token)]
    return [
        "bias", f"d{min(digits, 20)}", f"l{min(letters.bit_length(), 5)}", f"long:{min(len(token) // 8, 6)}", "mixed" if digits >= 4 and letters >= 4 and token.isalnum() else "plain", f"groups:{'.'.join(map(str, groups[:5]))}", f"n{min(len(groups), 5)}",
        *(f"has{c}" for c in "@.+()-:/" if c in token), "at-dot" if "@" in token and "." in token.split("@", 1)[1] else "no-at-dot", f"before:{before}" if before in CUES else BARE,
    ]


BARE = "before:-"
#: Words that announce personal data.
CUES = frozenset("address api apikey bearer call card cell contact email fax host ip key mail mobile passwd password phone secret server tel telephone token visa write".split())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Field:
    def __init__(self, index: dict[str, int], w: np.ndarray, edge: np.ndarray):
        self.index, self.w, self.edge = index, w, edge  # edge[kind, label, label]: log potentials

    @staticmethod
    def fit(features: list[list[str]], labels: list[int], edges: list[tuple[int, int, int]], rounds: int = 200) -> Field:
        """Node weights by the likelihood of a form's label given the features of its hub and all its tokens, edge weights by that
        of each label given its features and its neighbours' labels.

        edges: (node, node, kind)."""
        index: dict[str, int] = {}
        found = [[index.setdefault(f, len(index)) for f in fs] for fs in features]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        cols = np.array([i for f in found for i in f], int)
        n = len(KINDS) + 1
        gold = np.eye(n)[labels]
        e = np.array(edges, int).reshape(-1, 3)
        to, by, kind = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), np.concatenate([e[:, 2]] * 2)
        # Labels around a node, by edge kind, scaled so that a hub's many tokens count as a few.
        share = 1 / np.sqrt(np.maximum(np.bincount(to, minlength=len(found)), 1))
        around = np.zeros((3, len(found), n))
        np.add.at(around, (kind, to), gold[by] * share[to][:, None])
        prior = np.stack([np.zeros((n, n)), np.zeros((n, n)), SAME * np.eye(n)])
        form = np.arange(len(found))  # a token with repeats: its hub
        form[e[e[:, 2] == 2, 0]] = e[e[:, 2] == 2, 1]
        theta = [np.zeros((len(index), n)), prior.copy()]
        m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        for step in range(1, rounds + 1):
            w, edge = theta
            own, whole = np.zeros((len(found), n)), np.zeros((len(found), n))
            np.add.at(own, rows, w[cols])
            np.add.at(whole, form, own)
            off = gold - _softmax(whole)
            gw = np.zeros_like(w)
            np.add.at(gw, cols, off[form[rows]])
            ge = np.einsum("kia,ib->kab", around, gold - _softmax(own + np.einsum("kia,kab->ib", around, edge)))
            grads = [gw / len(found) - 1e-4 * w, (ge + ge.transpose(0, 2, 1)) / 2 / len(found) - 1e-2 * (edge - prior)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                theta[i] = theta[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return Field(index, theta[0], np.clip(theta[1], -10, 10))

    def marginals(self, graphs: list[Graph]) -> np.ndarray:
        """Label probabilities of all tokens of all graphs; labels given by the patterns are held fixed."""
        get, n = self.index.get, len(KINDS) + 1
        phi = np.array([self.w[[i for f in fs if (i := get(f)) is not None]].sum(0) for g in graphs for fs in g.features]).reshape(-1, n)
        given = np.array([y for g in graphs for y in g.labels], int)
        phi[given > 0] = -30
        phi[np.flatnonzero(given > 0), given[given > 0]] = 0
        first = np.cumsum([0, *(len(g.features) for g in graphs)])
        edges = np.array([(a + o, b + o, k) for g, o in zip(graphs, first, strict=False) for a, b, k in g.edges], int).reshape(-1, 3)
        belief = phi
        if len(edges):
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            psi = self.edge[np.concatenate([edges[:, 2]] * 2)]
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(src), n))
            for _ in range(ROUNDS):
                belief = phi.copy()
                np.add.at(belief, dst, message)
                out = belief[src] - message[back]
                new = np.logaddexp.reduce(out[:, :, None] + psi, axis=1)
                new -= new.max(1, keepdims=True)
                change = np.abs(new - message).max()
                message = 0.5 * message + 0.5 * new
                if change < TOLERANCE:
                    break
            belief = phi.copy()
            np.add.at(belief, dst, message)
        return _softmax(belief)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_tokens: int = TRAIN_TOKENS) -> Field | None:
    """Learn from the documents with the smallest hash of their id and text among those that may hold personal data, whole,
    in the order of the hash, leaving out those that would go over max_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                g = Graph(t, base_spans(t))
                if g.spans and len(g.features) <= max_tokens:
                    yield pa.RecordBatch.from_pylist([{"h": h, "features": g.features, "labels": g.learn, "edges": [list(e) for e in g.edges]}], schema=schema)
        release()

    schema = pa.schema([("h", pa.int64()), ("features", pa.list_(pa.list_(pa.string()))), ("labels", pa.list_(pa.int32())), ("edges", pa.list_(pa.list_(pa.int32())))])
    arrow_rows(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("id", "text").alias("h"), "text")
    chosen = rows.select("h").distinct().orderBy("h").limit(max_docs)
    # Rows that repeat id and text have one hash and give equal graphs: one of them counts.
    made = rows.join(F.broadcast(chosen), "h").select("h", "text").mapInArrow(run, "h long, features array<array<string>>, labels array<int>, edges array<array<int>>")
    graphs = materialize(made.groupBy("h").agg(F.min(F.struct("features", "labels", "edges")).alias("g")).select("h", F.size("g.features").alias("n"), "g.*"))
    # Only as many as fit reach the driver; their sizes come first.
    left, want = max_tokens, []
    for r in graphs.select("h", "n").orderBy("h").collect():
        if r.n <= left:
            left -= r.n
            want.append((r.h,))
    if not want:
        return None
    features, labels, edges = [], [], []
    kept = graphs.join(F.broadcast(docs.sparkSession.createDataFrame(want, "h long")), "h", "left_semi").drop("n").collect()
    for r in sorted(kept, key=lambda r: r.h):
        at = len(features)
        features += r.features
        labels += r.labels
        edges += [(a + at, b + at, k) for a, b, k in r.edges]
    return Field.fit(features, labels, edges)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end, kind, base) of every row; ends are exclusive, in code points."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field.index, field.w, field.edge) if field else None)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value) if shared.value else None
        for batch in batches:
            for ids, texts in text_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[list[tuple]] = []
                graphs, where = [], []
                for i, t in enumerate(texts):
                    base = base_spans(t) if t else []
                    found.append([(s, e, k, True) for s, e, k in base])
                    if model and t and (_DIGIT.search(t) or "@" in t):
                        g = Graph(t, base)
                        if g.spans:
                            graphs.append(g)
                            where.append(i)
                if graphs and model:
                    p = model.marginals(graphs)
                    at = 0
                    for i, g in zip(where, graphs, strict=True):
                        own = p[at : at + len(g.features)]
                        at += len(g.features)
                        found[i] += g.added(own)
                        found[i].sort(key=lambda x: (x[0], x[2], x[1]))
                spans = [[{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, e, k, b in f] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])
        release()

    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string, base: boolean>>")


def op4_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = F.filter("spans", lambda s: s.base)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    added = F.size(F.filter("spans", lambda s: ~s.base)).cast("long")
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, train(docs)).select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added.alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
