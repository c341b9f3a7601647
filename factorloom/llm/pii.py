"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field reads the chains of words around digits and at signs, is
trained from a small labelled table by its exact gradient, and is decoded by Viterbi over batches of
chains. It adds spans that no pattern covers, such as telephone numbers without a country code and
secrets; it takes none away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import id_and_text, rows_to_batch, text_blocks

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
STATES = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone", "B-secret")
#: Words on either side of a word with a digit or an at sign that belong to its chain.
REACH = 3
CACHE = 200_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches; each at sign is tried once, so the time is linear."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        local = _LOCAL.match(text[floor:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            out.append((at - local, found.end(), "email"))
        floor = found.end() if found else at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[Span]:
    """Of a run of numbers and dots every four numbers from the left are a match, whatever they are."""
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end, "ip"))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for run in _CARD.finditer(text):
        if _is_card(run.group()):
            out.append((run.start(), run.end(), "card"))
    return out


def _is_card(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> list[Span]:
    out = []
    for run in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, run.group())) <= 15:
            out.append((run.start(), run.end(), "phone"))
    return out


def base_spans(text: str) -> list[Span]:
    """All pattern spans, by start and then kind."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += ips(text) + cards(text)
        if "+" in text:
            out += phones(text)
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# --- the field ---


def word_features(word: str) -> list[str]:
    """Shape features of one word."""
    core = word.strip("\"'#$%&*!,;:|<>[]{}")
    digits = sum(map(str.isdigit, core))
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[^A-Za-z0-9@.()+=_-]", "x", re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", core)))))
    out = ["bias", f"shape={shape[:8]}", f"length={min(len(core) // 4, 12)}", f"digits={min(digits, 20)}"]
    if digits:
        out.append("all digits" if digits == len(core) else "some digits")
    if "@" in core:
        out.append("at sign" if "." in core.rpartition("@")[2] and core[0] != "@" else "lone at sign")
    if core.count(".") == 3 and core.replace(".", "").isdigit():
        out.append("four numbers")
    if len(core) >= 20 and re.fullmatch("[0-9A-Za-z_/+-]+", core) and digits >= 4 and re.search("[A-Za-z]", core):
        out.append("long mixed")
    if re.fullmatch("[0-9a-f]{24,}", core):
        out.append("long hexadecimal")
    if re.fullmatch(r"\(?[0-9]{3}\)?", core):
        out.append("area code")
    if re.fullmatch("[0-9]{3}[-.][0-9]{4}", core) or re.fullmatch(r"\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}", core):
        out.append("local number")
    if re.fullmatch("[0-9]{4}", core):
        out.append("four digits")
    if core.startswith("+") and digits:
        out.append("plus")
    plain = core.replace("-", "")
    if plain.isdigit() and 14 <= len(plain) <= 19:
        out.append("checked number" if luhn(plain) else "unchecked number")
    return out


def labelled_rows(seed: int = 7, sentences: int = 320) -> list[tuple[int, int, str, str]]:
    """The small labelled table: (sentence, position, word, label), built from templates.

    About half of the numbers are no personal data: years, counts, prices, sizes, times, long numbers
    with a wrong check digit.
    """
    rng = np.random.default_rng(seed)
    fill = "lorem the and contact office of report about near sent by from with call reach token key value page size was in".split()

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def number_with_check(n: int) -> str:
        body = digits(n - 1)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def wrap(word: str) -> str:
        return word + str(rng.choice(["", "", "", ".", ",", "###", "$$$", "&&&", "%%%", "***", ";", ":", "\""]))

    def email() -> list[tuple[str, str]]:
        return [(f"{rng.choice(['ann', 'j.doe', 'info', 'x_y'])}{digits(2)}@{rng.choice(['mail', 'site', 'post'])}{digits(1)}.{rng.choice(['com', 'org', 'example.net'])}", "B-email")]

    def ip() -> list[tuple[str, str]]:
        return [(".".join(str(x) for x in rng.integers(0, 256, 4)), "B-ip")]

    def card() -> list[tuple[str, str]]:
        n = number_with_check(16)
        if rng.random() < 0.5:
            return [(n, "B-card")]
        return [(n[i : i + 4], "B-card" if not i else "I-card") for i in range(0, 16, 4)]

    def phone() -> list[tuple[str, str]]:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a})", b, c]]
        words = forms[int(rng.integers(len(forms)))]
        return [(w, "B-phone" if not i else "I-phone") for i, w in enumerate(words)]

    def secret() -> list[tuple[str, str]]:
        body = "".join(rng.choice(list("0123456789abcdef"), 40 if rng.random() < 0.7 else 32))
        return [("token", "O"), ("=", "O"), (f'"{body}"', "B-secret")]

    def other() -> list[tuple[str, str]]:
        forms = [str(rng.integers(1800, 2100)), digits(1), digits(2), f"{digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", digits(5), digits(8), f"{digits(4)}-{digits(2)}-{digits(2)}", "@", "@home", f"No.{digits(3)}", f"{digits(2)}%", f"A{digits(2)}", digits(10), digits(12)]
        return [(forms[int(rng.integers(len(forms)))], "O")]

    def no_card() -> list[tuple[str, str]]:
        """As long as a card number, but the check digit is wrong: an order or article number."""
        n = number_with_check(int(rng.integers(14, 20)))
        return [(n[:-1] + str((int(n[-1]) + int(rng.integers(1, 10))) % 10), "O")]

    makers = [email, ip, card, phone, secret, no_card, other, other, other, other, other]
    rows = []
    for s in range(sentences):
        words: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(1, 4))):
            words += [(str(rng.choice(fill)), "O") for _ in range(int(rng.integers(1, 5)))]
            found = makers[int(rng.integers(len(makers)))]()
            words += [*found[:-1], (wrap(found[-1][0]), found[-1][1])]
        words += [(str(rng.choice(fill)), "O") for _ in range(int(rng.integers(0, 4)))]
        rows += [(s, i, w, y) for i, (w, y) in enumerate(words)]
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "sentence int, position int, word string, label string")


def field_of(table: DataFrame, most: int = 200_000) -> Field:
    """A field trained from a small table(sentence, position, word, label); one of over `most` words is refused."""
    rows = table.select("sentence", "position", "word", "label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has over {most} words")
    return train([tuple(r) for r in rows])


@dataclass
class Field:
    """Weights of a trained field: features by states, transitions, start and end scores."""

    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def scores(self, word: str) -> np.ndarray:
        at = [self.names[f] for f in word_features(word) if f in self.names]
        return self.emit[at].sum(axis=0)

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best states of each chain of emission scores (words x states), in batches of like length."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            longest = max(2 * len(chains[order[at]]), 8)
            batch = []
            while at < len(order) and len(chains[order[at]]) <= longest and len(batch) < 4096:
                batch.append(order[at])
                at += 1
            sizes = np.array([len(chains[i]) for i in batch])
            table = np.zeros((len(batch), sizes.max(), len(STATES)))
            for row, i in enumerate(batch):
                table[row, : sizes[row]] = chains[i]
            best, back = self.start + table[:, 0], np.zeros(table.shape, np.int8)
            for t in range(1, table.shape[1]):
                options = best[:, :, None] + self.step
                back[:, t] = options.argmax(axis=1)
                live = t < sizes
                best = np.where(live[:, None], options.max(axis=1) + table[:, t], best)
            state = (best + self.end).argmax(axis=1)
            paths = np.zeros((len(batch), table.shape[1]), np.int64)
            for t in range(table.shape[1] - 1, -1, -1):
                paths[:, t] = state
                if t:
                    state = np.where(t < sizes, back[np.arange(len(batch)), t, state], state)
            for row, i in enumerate(batch):
                out[i] = paths[row, : sizes[row]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[int, int, str, str]], rounds: int = 160, decay: float = 0.02) -> Field:
    """Maximum likelihood with weight decay by the exact gradient (forward and backward sums) and Adam."""
    chains: dict[int, list[tuple[str, str]]] = {}
    for s, _, word, label in sorted(rows, key=lambda r: (r[0], r[1])):
        chains.setdefault(s, []).append((word, label))
    names: dict[str, int] = {}
    tokens = [[[names.setdefault(f, len(names)) for f in word_features(w)] for w, _ in c] for c in chains.values()]
    n, longest, states, width = len(tokens), max(map(len, tokens)), len(STATES), len(names)
    x, y, mask = np.zeros((n, longest, width), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, chain in enumerate(chains.values()):
        for t, (_, label) in enumerate(chain):
            x[i, t, tokens[i][t]] = 1
            y[i, t], mask[i, t] = STATES.index(label), True
    sizes, flat, one = mask.sum(axis=1), x.reshape(-1, width), np.eye(states)
    weights = np.zeros(width * states + states * states + 2 * states)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    rows_at = np.arange(n)
    for r in range(1, rounds + 1):
        emit, step = weights[: width * states].reshape(width, states), weights[width * states : -2 * states].reshape(states, states)
        start, end = weights[-2 * states : -states], weights[-states:]
        scores = (flat @ emit).reshape(n, longest, states)
        forward, backward = np.zeros((n, longest, states)), np.zeros((n, longest, states))
        forward[:, 0] = start + scores[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(mask[:, t, None], _log_sum(forward[:, t - 1, :, None] + step, 1) + scores[:, t], forward[:, t - 1])
        total = _log_sum(forward[:, -1] + end, 1)
        backward[:, -1] = end
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(mask[:, t + 1, None], _log_sum(step + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2), end)
        chance = np.where(mask[:, :, None], np.exp(forward + backward - total[:, None, None]), 0)
        truth = np.where(mask[:, :, None], one[y], 0)
        g_emit = flat.T @ (truth - chance).reshape(-1, states)
        both = mask[:, 1:]
        pair = np.exp(forward[:, :-1, :, None] + step + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        g_step = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * both[:, :, None, None]).sum((0, 1)) - np.where(both[:, :, None, None], pair, 0).sum((0, 1))
        g_start = (truth[:, 0] - chance[:, 0]).sum(0)
        g_end = (truth[rows_at, sizes - 1] - chance[rows_at, sizes - 1]).sum(0)
        g = np.concatenate([g_emit.ravel(), g_step.ravel(), g_start, g_end]) - decay * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    emit, step = weights[: width * states].reshape(width, states), weights[width * states : -2 * states].reshape(states, states)
    return Field(names, emit, step, weights[-2 * states : -states], weights[-states:])


class Finder:
    """Finds all spans of texts with a trained field; emission scores of words are kept up to CACHE."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}

    def _scores(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = self.field.scores(word)
        return found

    def chains(self, text: str) -> list[list[tuple[int, int]]]:
        """Runs of words, as offsets, of which each is within REACH of a word with a digit or an at sign."""
        if not _CUE.search(text):
            return []
        words = [w.span() for w in _WORD.finditer(text)]
        out, until = [], -1
        for i, (a, b) in enumerate(words):
            if _CUE.search(text, a, b):
                lo = max(i - REACH, until + 1)
                if lo <= until + 1 and out and lo == until + 1 and until >= 0:
                    out[-1] += words[lo : i + REACH + 1]
                else:
                    out.append(words[lo : i + REACH + 1])
                until = min(i + REACH, len(words) - 1)
        return out

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """For each text its base spans, and all spans."""
        places, scores = [], []
        for k, text in enumerate(texts):
            for chain in self.chains(text):
                places.append((k, chain))
                scores.append(np.stack([self._scores(text[a:b]) for a, b in chain]))
        base = [base_spans(t) for t in texts]
        more: list[list[Span]] = [[] for _ in texts]
        for (k, chain), states in zip(places, self.field.viterbi(scores), strict=True):
            more[k] += _spans_of(texts[k], chain, states.tolist())
        out = []
        for b, extra in zip(base, more, strict=True):
            out.append((b, sorted(b + _free(extra, b), key=_order)))
        return out


def _spans_of(text: str, chain: list[tuple[int, int]], states: list[int]) -> list[Span]:
    out, at = [], 0
    while at < len(states):
        name = STATES[states[at]]
        if name == "O":
            at += 1
            continue
        kind, first = name[2:], at
        at += 1
        while at < len(states) and STATES[states[at]] == f"I-{kind}":
            at += 1
        a, b = chain[first][0], chain[at - 1][1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if b > a and _CUE.search(text, a, b) and (kind != "card" or _is_card(text[a:b])):
            out.append((a, b, kind))
    return out


def _free(extra: list[Span], base: list[Span]) -> list[Span]:
    """The spans of extra that overlap none of base and none before them."""
    taken, out = sorted((a, b) for a, b, _ in base), []
    i, floor = 0, 0
    reach = 0
    for a, b, kind in sorted(extra, key=_order):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if a >= reach and a >= floor:
            out.append((a, b, kind))
            floor = b
    return out


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the personal data of every row's whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points, end
    exclusive). Spans that the field adds overlap none of the patterns', and added cards have a right check digit
    too. Null and empty texts have none; repeated rows give equal rows; a null doc_id stays null; an empty table gives no
    rows; spans of different patterns may overlap; extra columns are ignored.
    """
    field = field or field_of(labelled_table(docs.sparkSession))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for ids, texts in text_blocks(batches):
            rows = []
            for i, (base, every) in zip(ids, finder.find(texts), strict=True):
                kinds = [k for _, _, k in base]
                rows.append((i, *map(kinds.count, BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield rows_to_batch(rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    end, kind, start = -1, "", 0
    for a, b, k in [*spans, (len(text) + 1, len(text) + 1, "")]:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        start, end, kind = a, b, k
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, field: Field | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with personal data in its text replaced by kinds, and the length column brought up to date.

    Null texts stay null; all other columns are passed on as they are.
    """
    field = field or field_of(labelled_table(docs.sparkSession))

    @F.pandas_udf("string")
    def cleaned(texts):
        import pandas as pd

        finder = Finder(field)
        values = [t if t is not None else "" for t in texts]
        return pd.Series([redact(t, every) for t, (_, every) in zip(values, finder.find(values), strict=True)])

    out = docs.withColumn(text_col, F.when(docs[text_col].isNotNull(), cleaned(docs[text_col])))
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
