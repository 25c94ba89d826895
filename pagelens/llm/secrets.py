"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are the white-space words of the whole text. Each has observations: its own shape (length,
digits, capitals, punctuation, hexadecimal), the shapes of both neighbours, whether one of the three
words before, or its own start, is a cue such as `password` or `token`, and a feature of the file
(cues seen in it). The field tags them begin, inside or outside a secret; Viterbi decodes the best
path over each whole document. A run of begin and inside is one span of kind `crf`, unless a base
span overlaps it. Base spans are always kept.

The field is taught more than the patterns know. Labels are the values of base spans; every training
document with one is seen again with its secrets redrawn from other alphabets, behind other cues and
signs, few of which a pattern has. Views of all documents with the neighbours' shapes withheld, and of
redrawn ones also with cues withheld or shapes made coarse, keep one kind of evidence from standing for
all. Weights are fitted by gradient ascent on the conditional likelihood of whole documents, cut in
pieces between tokens outside any secret. The sample is bounded: of the `pool` documents with the least
hash of doc_id, of at most `max_bytes`, `sample` with a cue and `sample` without. Their observations
are made by the tasks.

Long texts are decoded in blocks: the best way through a block from each tag to each is a max-plus
matrix, all blocks in step; the matrices are multiplied along the text, and all blocks are traced back
in step.

Defined results: null text is empty and has no spans; without training documents, or without a base
span among them, the field adds nothing. Repeated rows and null ids are rows like others. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import chunks, id_slice, whole_id, word_hashes
from pagelens.scratch import stored

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Fixed cue words.
CUES = "password passwd pwd secret token apikey api_key key auth bearer credential private_key access_key client_secret".split()
_STEMS = re.compile("|".join(["passw", "secret", "token", "api_?key"]), re.I | re.A)
SAMPLE, POOL, MAX_BYTES, PIECE, BLOCK = 200, 16000, 1 << 16, 48, 128


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), code points, sorted."""
    out = []
    if _STEMS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _hashed(word: str) -> int:
    return int(word_hashes([word.encode()])[0][0])


_CUE_HASHES = np.sort(np.array([_hashed(c + e) for c in CUES for e in ("", ":", "=", '":')], np.uint64))
SHAPES, CUE, FILE = 6 * 3 * 3 * 2 * 2 * 2, 5, 3
OFFSETS = np.cumsum([0, SHAPES, SHAPES, SHAPES, CUE, FILE])
N_OBS = int(OFFSETS[-1])
_BASES = (6, 3, 3, 2, 2, 2)


def _factors() -> np.ndarray:
    """Shapes x their parts: length, digits, capitals, marks, hexadecimal, quoted; each with a cell."""
    code, out = np.arange(SHAPES), []
    for base in reversed(_BASES):
        out.append(np.eye(base)[code % base])
        code = code // base
    return np.concatenate(out, 1)


FACTORS = _factors()


def observe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observations (tokens x 5 feature numbers), token starts and ends in code points of their own
    text, and tokens per text; vectorised over the joined bytes."""
    hashes, counts = word_hashes(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
    number = lambda mask: (lambda t: t[end] - t[start])(total(mask))
    n = end - start
    digit = number((buf >= 48) & (buf <= 57))
    upper = number((buf >= 65) & (buf <= 90))
    hexa = number(((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 102)))
    mark = number((buf == 43) | (buf == 47) | (buf == 95) | (buf == 61) | (buf == 45))
    quoted = np.isin(buf[start], np.frombuffer(b"\"'", np.uint8))
    size = np.searchsorted([4, 8, 16, 24, 36], n, side="right")
    shape = size
    for part, base in (((digit > 0) + (2 * digit > n) * 1, 3), ((upper > 0) + (2 * upper > n) * 1, 3), ((mark > 0) * 1, 2), ((hexa >= n - 2) * 1, 2), (quoted * 1, 2)):
        shape = shape * base + part
    doc = np.repeat(np.arange(len(texts)), counts)
    shift = lambda a, by: np.where(np.roll(doc, by) == doc, np.roll(a, by), 0) if len(a) > abs(by) else np.zeros_like(a)
    spot = np.minimum(np.searchsorted(_CUE_HASHES, hashes), len(_CUE_HASHES) - 1)
    cue = (_CUE_HASHES[spot] == hashes) * 1
    cued = np.bincount(doc, cue, len(texts))
    before = np.where(shift(cue, 1) > 0, 1, np.where(shift(cue, 2) > 0, 2, np.where(shift(cue, 3) > 0, 3, np.where(cue > 0, 4, 0))))
    file = np.minimum(cued, 2).astype(int)[doc]
    obs = np.stack([shape, shift(shape, 1), shift(shape, -1), before, file], 1) + OFFSETS[:5]
    chars = total((buf & 0xC0) != 0x80)
    base = chars[np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(int)][doc]
    return obs, chars[start] - base, chars[end] - base, counts


class Field:
    """Weights of the field: observations x 3 tags, 3 x 3 transitions, 3 starts. Tags: O, B, I."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit, self.move = emit, move

    @staticmethod
    def fit(seqs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> Field:
        """seqs: (observations, tags). AdaGrad on the mean conditional log-likelihood. A token's own
        shape weighs what its parts weigh and little of its own, so that unseen shapes are judged by
        their parts."""
        emit, move = np.zeros((N_OBS, 3)), np.zeros((3, 3))
        move[0, 2] = -8.0  # inside never follows outside
        n, width = len(seqs), max(len(t) for _, t in seqs)
        known, inv = np.unique(np.concatenate([o for o, _ in seqs]), axis=0, return_inverse=True)
        seq = np.repeat(np.arange(n), [len(t) for _, t in seqs])
        pos = np.concatenate([np.arange(len(t)) for _, t in seqs])
        tags = np.concatenate([t for _, t in seqs])
        live = np.zeros((width, n), bool)  # positions first: all sequences advance in step
        live[pos, seq] = True
        gold_e = np.stack([np.bincount(inv, tags == k, len(known)) for k in range(3)], 1)
        follows = np.flatnonzero(pos[1:] > 0)
        gold_m = np.bincount(tags[follows] * 3 + tags[follows + 1], minlength=9).reshape(3, 3)
        seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
        part, whole = np.zeros((FACTORS.shape[1], 3)), np.zeros((SHAPES, 3))  # a token's own shape: its parts' weights and its own
        seen_p, seen_w = np.full_like(part, 1e-8), np.full_like(whole, 1e-8)
        psi, alpha, beta, norm = np.ones((width, n, 3)), np.zeros((width, n, 3)), np.ones((width, n, 3)), np.ones((width, n))
        for _ in range(rounds):
            score = emit[known].sum(1)
            psi[pos, seq] = np.exp(score - score.max(1, keepdims=True))[inv]
            step = np.exp(move)
            two = np.zeros((3, 3))
            for t in range(width):
                a = psi[0] if t == 0 else (alpha[t - 1] @ step) * psi[t]
                norm[t] = np.where(live[t], a.sum(1), 1.0)
                alpha[t] = np.where(live[t, :, None], a / norm[t, :, None], 0.0)
            for t in range(width - 2, -1, -1):
                ahead = psi[t + 1] * beta[t + 1] / norm[t + 1, :, None] * live[t + 1, :, None]
                beta[t] = np.where(live[t + 1, :, None], ahead @ step.T, 1.0)
                two += alpha[t].T @ ahead * step
            soft = (alpha * beta)[pos, seq]
            gap = gold_e - np.stack([np.bincount(inv, soft[:, k], len(known)) for k in range(3)], 1)
            grad = np.zeros_like(emit)
            for k in range(known.shape[1]):
                for tag in range(3):
                    grad[:, tag] += np.bincount(known[:, k], gap[:, tag], N_OBS)
            grad /= n
            grad_p, grad_w = FACTORS.T @ grad[:SHAPES] - penalty * part, grad[:SHAPES] - 10 * penalty * whole
            seen_p += grad_p**2
            seen_w += grad_w**2
            part += rate * grad_p / np.sqrt(seen_p)
            whole += rate * 0.1 * grad_w / np.sqrt(seen_w)
            grad -= penalty * emit
            grad_m = (gold_m - two) / n
            grad_m[0, 2] = 0
            seen_e += grad**2
            seen_m += grad_m**2
            emit += rate * grad / np.sqrt(seen_e)
            emit[:SHAPES] = FACTORS @ part + whole
            move += rate * grad_m / np.sqrt(seen_m)
        return Field(emit, move)

    def decode(self, obs: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Viterbi tags of all tokens."""
        score = self.emit[obs].sum(1)
        n = len(score)
        if not n:
            return np.zeros(0, np.int8)
        counts = counts[counts > 0]
        per = -(-counts // block)  # blocks of each text
        owner = np.repeat(np.arange(len(counts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = (np.cumsum(counts) - counts)[owner] + nth * block
        size = np.minimum(block, counts[owner] - nth * block)
        order = np.argsort(-size, kind="stable")  # blocks with more than t tokens come first
        begin, size = begin[order], size[order]
        live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        last = np.cumsum(per) - 1
        first = last - per + 1
        lead = place[first]
        begun = score[begin[lead]] + np.array([0.0, 0.0, -1e9])  # a text never starts inside
        into = self.move + score[begin][:, None, :]  # best way from the tag before the block to its t-th tag
        into[lead] = begun[:, None, :]
        for t in range(1, len(live)):
            k = live[t]
            into[:k] = (into[:k, :, :, None] + self.move).max(2) + score[begin[:k] + t][:, None, :]
        entry = np.zeros((len(size), 3))  # best score of each tag before the block
        best = into[lead, 0].copy()
        texts = np.argsort(-per, kind="stable")
        deep = [int(np.searchsorted(-per[texts], -j, side="left")) for j in range(int(per.max()))]
        for j in range(1, len(deep)):
            rows = texts[: deep[j]]
            mine = place[first[rows] + j]
            entry[mine] = best[rows]
            best[rows] = (best[rows][:, :, None] + into[mine]).max(1)
        # forward again with pointers, each block from its own entry
        back = np.zeros((n, 3), np.int8)
        step = entry[:, :, None] + self.move
        back[begin] = step.argmax(1)
        now = step.max(1) + score[begin]
        now[lead] = begun
        for t in range(1, len(live)):
            k = live[t]
            step = now[:k, :, None] + self.move
            back[begin[:k] + t] = step.argmax(1)
            now[:k] = step.max(1) + score[begin[:k] + t]
        # trace every block back from each of its last tags; then choose along the text
        way = np.zeros((n, 3), np.int8)
        tag = np.tile(np.arange(3, dtype=np.int8), (len(size), 1))
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            spot = begin[:k] + t
            way[spot] = tag[:k]
            tag[:k] = np.take_along_axis(back[spot], tag[:k], 1)
        chosen = np.zeros(len(size), np.int8)
        end = now[place[last]].argmax(1).astype(np.int8)
        for j in range(len(deep)):
            rows = texts[: deep[j]]
            mine = place[last[rows] - j]
            chosen[mine] = end[rows]
            end[rows] = tag[mine, end[rows]]
        whole = np.repeat(chosen[place], size[place])
        return way[np.arange(n), whole]


def _tags(spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tags of one text's tokens. Of an assignment the value's token alone is the secret."""
    tags = np.zeros(len(start), int)
    for a, kind, b in spans:
        hit = np.flatnonzero((start < b) & (end > a))
        hit = hit[-1:] if kind == 0 else hit
        tags[hit] = 2
        if len(hit):
            tags[hit[0]] = 1
    return tags


#: Alphabets, signs and lengths of redrawn secrets.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = ("0123456789abcdef", "0123456789" + _LETTERS, "0123456789" + _LETTERS + _LETTERS.upper(), "0123456789+/" + _LETTERS + _LETTERS.upper(), "0123456789" + _LETTERS.upper())
SIGNS = (" = ", ": ", " ", " is ", " := ")


def redrawn(text: str, spans: list[tuple[int, int, int]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with each secret redrawn from another alphabet and, where it is an assignment, another
    cue and sign; and where the new secrets stand."""
    rng, out, found, at, size = random.Random(seed), [], [], 0, 0
    for a, kind, b in spans:
        if a < at:
            continue
        value = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(16, 48)))
        quote = rng.choice(('"', "'", "", ""))
        lead = text[at:a] + (rng.choice(CUES) + rng.choice(SIGNS) + quote if kind == 0 else "")
        out += [lead, value, quote if kind == 0 else ""]
        found.append((size + len(lead), 2, size + len(lead) + len(value)))
        size, at = size + sum(map(len, out[-3:])), b
        while kind == 0 and at < len(text) and text[at] in "\"'":
            at += 1
    return "".join([*out, text[at:]]), found


def _withheld(obs: np.ndarray) -> Iterator[np.ndarray]:
    """Observations without the neighbours' shapes: so, without cues, and with the shapes' length,
    mark and hexadecimal part withheld."""
    bare = obs.copy()
    bare[:, 1], bare[:, 2] = OFFSETS[1], OFFSETS[2]
    yield bare
    cueless = bare.copy()
    cueless[:, 3], cueless[:, 4] = OFFSETS[3], OFFSETS[4]
    yield cueless
    coarse = bare.copy()
    mixed = (bare[:, 0] // 24 % 3 > 0) & (bare[:, 0] // 72 >= 2)
    coarse[mixed, 0] = 2 * 72 + bare[mixed, 0] % 72 // 8 * 8
    yield coarse


def _pieces(obs: np.ndarray, tags: np.ndarray, piece: int = PIECE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The whole sequence in pieces of about `piece` tokens, each starting outside a secret."""
    out, a = [], 0
    while a < len(tags):
        b = min(a + piece, len(tags))
        while b < len(tags) and tags[b]:
            b += 1
        out.append((obs[a:b], tags[a:b]))
        a = b
    return out


_CUE = r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{24}|pwd|bearer|credential"


def examples(docs: DataFrame, sample: int = SAMPLE, pool: int = POOL, max_bytes: int = MAX_BYTES) -> list:
    """cue, obs, tags of the training documents, and obs2, tags2 of them redrawn, made in one pass over
    the texts."""
    rows = docs.where("text is not null and doc_id is not null")
    total = max(1, docs.count())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = rows.select(F.col("doc_id").cast("long"), "text", share.alias("h")).where((F.col("h") <= pool / total) & (F.octet_length("text") <= max_bytes))
    rows = rows.withColumn("cue", F.col("text").rlike(_CUE)).where(F.col("cue") | (F.col("h") <= 2.0 * sample / total))

    def observed(raw: bytes, spans: list) -> tuple[bytes, bytes]:
        obs, start, end, _ = observe([raw])
        return obs.astype("<u2").tobytes(), _tags(spans, start, end).astype(np.uint8).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist(), 256 << 10):
                packed = []
                for raw, text, seed in zip(texts, pdf["text"].iloc[a:b], pdf["seed"].iloc[a:b]):
                    spans = base_spans(text)
                    views = [observed(raw, spans)]
                    if spans:
                        other, placed = redrawn(text, spans, int(seed))
                        views.append(observed(other.encode("utf-8", "surrogatepass"), placed))
                    packed.append([x for view in views for x in view] + [b""] * (4 - 2 * len(views)))
                out = pdf.iloc[a:b][["doc_id", "h", "cue"]].reset_index(drop=True)
                out[["obs", "tags", "obs2", "tags2"]] = pd.DataFrame(packed, columns=["obs", "tags", "obs2", "tags2"])
                yield out

    made = rows.select("doc_id", "text", "h", "cue", F.hash("doc_id").alias("seed")).mapInPandas(run, "doc_id long, h double, cue boolean, obs binary, tags binary, obs2 binary, tags2 binary")
    made = stored(made.dropDuplicates(["doc_id", "cue"]), "examples")
    return [r for cue in (True, False) for r in made.where(F.col("cue") == cue).orderBy("h", "doc_id").limit(sample).collect()]


def train(docs: DataFrame, **options) -> Field:
    seqs, found = [], False
    unpacked = lambda o, t: (np.frombuffer(o, "<u2").reshape(-1, len(OFFSETS) - 1).astype(int), np.frombuffer(t, np.uint8).astype(int))
    for r in examples(docs, **options):
        obs, tags = unpacked(r["obs"], r["tags"])
        if r["cue"] and not tags.any():
            continue  # what follows its cues is neither known to be a secret nor known not to be
        found |= bool(tags.any())
        seqs += _pieces(obs, tags) + _pieces(next(_withheld(obs)), tags)
        if r["tags2"]:
            obs, tags = unpacked(r["obs2"], r["tags2"])
            for one in (obs, *_withheld(obs)):
                seqs += _pieces(one, tags)
    return Field.fit(seqs) if found else Field()


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    field = field or train(docs)

    def said(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, texts in chunks(pdf["text"].tolist()):
                obs, start, end, counts = observe(texts)
                tags = field.decode(obs, counts) if field.emit is not None else np.zeros(len(start), np.int8)
                at = np.concatenate(([0], np.cumsum(counts)))
                marked = np.flatnonzero(tags)
                owner = np.searchsorted(at, marked, side="right") - 1
                more: dict[int, list[list[int]]] = {}
                for i, o in zip(marked.tolist(), owner.tolist()):
                    runs = more.setdefault(o, [])
                    if tags[i] == 2 and runs and runs[-1][2] == i - 1:
                        runs[-1][1:] = [int(end[i]), i]
                    else:
                        runs.append([int(start[i]), int(end[i]), i])
                rows = []
                for i, t in enumerate(pdf["text"].iloc[a:b]):
                    base = base_spans(t) if isinstance(t, str) else []
                    extra = [(s, 3, e) for s, e, _ in more.get(i, ()) if not any(s < y and x < e for x, _, y in base)]
                    kinds = [k for _, k, _ in base]
                    rows.append((*[kinds.count(k) for k in range(3)], hashlib.sha256(said(base).encode()).hexdigest(), said(base + extra)))
                out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
                out.insert(0, "doc_id", id_slice(pdf, "doc_id", a, b))
                yield out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(*whole_id("doc_id"), "text").mapInPandas(run, schema)
