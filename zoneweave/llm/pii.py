"""PII: labelers vote on candidate spans, EM weighs the labelers kind by kind, a span classifier learns from the posteriors."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, table, texts_of

#: Kinds in their order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "name", "id", "secret")
EMAIL, IP, CARD, PHONE, NAME, ID, SECRET = range(7)
#: Base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser patterns, whose spans are candidates only.
AT = re.compile(r"(?i)[\[(]at[\])]")
SPELLED = re.compile(r"(?i) ?[A-Z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Z0-9-]+)+")
NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
PERSON = re.compile(r"\b([A-Z][a-z]+)\.? ([A-Z][a-z]+)(?: [A-Z][a-z]+)?\b")
ASSIGNED = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_.-]{8,})")
KEY = re.compile(r"\b(?:[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{32,64})\b")
#: Gazetteers (first names, forms of address, top-level domains, issuer prefixes, key prefixes) and context words.
FIRST = frozenset(
    "Adam Alexander Alice Amanda Andrea Andrew Angela Anna Anne Antonio Barbara Benjamin Carlos Carmen Carol Caroline Catherine Charles Charlotte Christian Christina Christine "
    "Christopher Claire Claudia Daniel David Deborah Diana Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francisco Frank Gabriel George Hannah Heather Helen "
    "Henry Isabel Isabelle Jack Jacob James Jane Janet Jason Jean Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Joshua Juan Julia Julie Karen Katherine Kevin Klaus Laura Linda "
    "Lisa Louis Lucia Luis Manuel Marc Margaret Maria Marie Mark Martin Mary Matthew Michael Michelle Monika Nancy Nathalie Nicholas Nicole Olivia Oscar Pablo Pamela Patricia Patrick "
    "Paul Pedro Peter Philip Pierre Rachel Raymond Rebecca Richard Robert Roger Ronald Rosa Ruth Samuel Sandra Sara Sarah Scott Sebastian Sophie Stephanie Stephen Steven Susan Sylvie "
    "Teresa Thomas Timothy Ursula Victor Walter William".split()
)
ADDRESSED = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Sr Sra Señor Señora".split())
TLD = ("com", "org", "net", "edu", "gov", "io", "eu", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "be")
ISSUER = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "xoxb", "sk-", "eyJ")
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "reach", "kontakt", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "login", "from", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "amex", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "name": ("name", "mr", "mrs", "ms", "dr", "dear", "by", "contact", "herr", "frau", "madame", "señor"), "id": ("ssn", "social", "security", "tax", "id", "passport"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "api", "access"),
}
AGAINST = ("isbn", "version", "release", "order", "invoice", "item", "no.", "figure", "table", "page", "section", "#")
#: Labelers: strict pattern, check digits, gazetteer, context, counter-context, shape.
VOTERS = 6
WORD = re.compile(r"[^\W\d_]+|#|no\.")
#: Hashed features of a span, and the spans a kind that the classifier is fitted on, at most.
FEATURES, PER_KIND = 512, 4000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def local_start(text: str, end: int, floor: int) -> int:
    s = end
    while s > floor and text[s - 1] in LOCAL:
        s -= 1
    return s


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans, found from each @ outward instead of from each character on."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        s = local_start(text, at, floor)
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def spelled_emails(text: str) -> list[tuple[int, int]]:
    """E-mails with (at) or [at], from each of these outward; a name starts with a letter, digit or underscore."""
    out, floor = [], 0
    for m in AT.finditer(text):
        if m.start() < floor:
            continue
        end = m.start() - (m.start() > floor and text[m.start() - 1] == " ")
        s = local_start(text, end, floor)
        while s < end and not (text[s].isalnum() or text[s] == "_"):
            s += 1
        to = SPELLED.match(text, m.end()) if s < end else None
        if to:
            out.append((s, to.end()))
            floor = to.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Dotted quads: four groups of digits each time in a run of dotted groups; those with a part over 255 are dropped."""
    out = []
    for m in GROUPS.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four base kinds, each leftmost and non-overlapping; failing matches are dropped."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if not re.search("[0-9]", text):
        return out
    out[IP] = addresses(text)
    for m in NUMBER.finditer(text):
        d = digits_of(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out[CARD].append(m.span())
    if "+" in text:
        out[PHONE] = [m.span() for m in DIALLED.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def loose(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser patterns, in no order, overlaps included."""
    found = [(EMAIL, *x) for x in spelled_emails(text)] if "(" in text or "[" in text else []
    if re.search("[0-9]", text):
        found += [(PHONE, *m.span()) for m in NATIONAL.finditer(text)] + [(ID, *m.span()) for m in SOCIAL.finditer(text)]
        found += [(CARD, *m.span()) for m in NUMBER.finditer(text) if m.end() - m.start() < 40 and 13 <= len(digits_of(m[0])) <= 16]
        found += [(SECRET, *m.span()) for m in KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(SECRET, *m.span(1)) for m in ASSIGNED.finditer(text)]
    return found + [(NAME, *m.span()) for m in PERSON.finditer(text) if m[1] in FIRST or m[1] in ADDRESSED]


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) beyond the base: looser spans that overlap no base span and no earlier candidate."""
    found = sorted(loose(text), key=lambda x: (x[1], x[0], x[2]))
    if not found:
        return []
    starts, ends, out, free = [], [], [], 0
    for s, e in sorted(x for spans in base for x in spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k, s, e in found:
        i = bisect_right(starts, s) - 1
        if s >= free and not (i >= 0 and s < ends[i]) and not (i + 1 < len(starts) and starts[i + 1] < e):
            out.append((k, s, e))
            free = e
    return out


def votes(text: str, kind: int, s: int, e: int, base: bool) -> str:
    """One character a labeler: + for, - against, 0 abstains."""
    span, before = text[s:e], text[max(0, s - 40) : s].lower()
    words = WORD.findall(before)[-5:]
    d = digits_of(span) if kind in (CARD, PHONE, ID) else ""
    strict = base or kind == SECRET and span.startswith(KEY_HEADS)
    check = {CARD: lambda: luhn(d), ID: lambda: d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000", PHONE: lambda: d[-7:-4] != "000"}.get(kind)
    listed = {
        EMAIL: lambda: span.rpartition(".")[2].lower() in TLD or None, IP: lambda: not span.startswith(("0.", "255.")), CARD: lambda: d.startswith(ISSUER), PHONE: lambda: None,
        NAME: lambda: span.split(" ")[0] in FIRST or None, ID: lambda: None, SECRET: lambda: span.startswith(KEY_HEADS) or None,
    }[kind]()
    edge = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    shape = {EMAIL: lambda: e - s <= 80, CARD: lambda: len(d) in (13, 15, 16), PHONE: lambda: len(d) >= 10, NAME: lambda: e - s <= 40, SECRET: lambda: any(map(str.isdigit, span))}.get(kind, lambda: True)()
    said = (strict or None, check() if check else None, listed, any(w in CONTEXT[KINDS[kind]] for w in words) or None, not any(w in AGAINST for w in words) and None, edge and shape)
    return "".join("0" if v is None else "+" if v else "-" for v in said)


def traits(text: str, kind: int, s: int, e: int) -> list[int]:
    """Ids of the span's own and context features: form, check digits and the words around it, hashed; no labeler's vote."""
    span = text[s : min(e, s + 256)]
    n = len(span)
    share = lambda f: round(4 * sum(map(f, span)) / n)
    d = digits_of(span)
    before, after = WORD.findall(text[max(0, s - 40) : s].lower())[-2:], WORD.findall(text[e : e + 24].lower())[:1]
    kind_of = lambda c: "" if not c else "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c
    own = [
        "", f"len{(e - s).bit_length()}", f"dig{share(str.isdigit)}", f"up{share(str.isupper)}", f"sep{''.join(sorted({c for c in span if not c.isalnum()}))[:4]}", f"n{len(d)}", f"luhn{luhn(d) and len(d) > 9}",
        f"hex{all(c in '0123456789abcdef' for c in span)}", f"tail{span.rpartition('.')[2][:4].lower() if kind == EMAIL else ''}", f"head{d[:1]}", f"l{kind_of(text[s - 1 : s])}", f"r{kind_of(text[e : e + 1])}",
        *(f"b{w}" for w in before), *(f"a{w}" for w in after),
    ]
    return sorted({zlib.crc32(f"{kind}:{x}".encode("utf-8", "surrogatepass")) % FEATURES for x in own})


def _find(id_col: str, text_col: str):
    span = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("traits", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            counts, sha, spans = [], [], []
            for text in texts_of(b, text_col):
                base = base_spans(text)
                flat = sorted((s, k, e) for k, part in enumerate(base) for s, e in part)
                counts.append([len(x) for x in base])
                sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in flat).encode()).hexdigest())
                rows = [(k, s, e, True) for s, k, e in flat] + [(k, s, e, False) for k, s, e in candidates(text, base)]
                spans.append([{"kind": k, "s": s, "e": e, "base": x, "votes": votes(text, k, s, e, x), "traits": traits(text, k, s, e)} for k, s, e, x in rows])
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.record_batch([b.column(id_col), *cols, pa.array(sha, pa.string()), pa.array(spans, pa.list_(span))], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])

    return run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:int,s:int,e:int,base:boolean,votes:string,traits:array<int>>>"


def reliabilities(patterns: list[str], n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over the vote patterns of one kind with counts: posterior of each pattern, and P(vote | class) a labeler and class.

    Votes are -, 0, +. The start believes the majority of votes; a prior of a few counts keeps a labeler
    better than chance until the data say otherwise.
    """
    v = np.array([["-0+".index(c) for c in p] for p in patterns])
    prior = np.array([[[2.0, 3.0, 1.0], [1.0, 3.0, 2.0]]] * VOTERS)
    post = 1 / (1 + np.exp(-(v - 1).sum(axis=1).astype(float)))
    rate = prior
    for _ in range(rounds):
        rate = prior.copy()
        for j in range(VOTERS):
            for y, w in ((0, 1 - post), (1, post)):
                rate[j, y] += np.bincount(v[:, j], w * n, 3)
        rate = rate / rate.sum(axis=2, keepdims=True)
        p = np.clip((post * n).sum() / n.sum(), 0.02, 0.98)
        z = np.log(p / (1 - p)) + sum(np.log(rate[j, 1, v[:, j]]) - np.log(rate[j, 0, v[:, j]]) for j in range(VOTERS))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, rate


def posteriors(groups: dict[tuple[int, str], int]) -> dict[tuple[int, str], float]:
    """Posterior of each (kind, votes) group; every kind has reliabilities of its own."""
    out = {}
    for kind in range(len(KINDS)):
        patterns = sorted(v for k, v in groups if k == kind)
        if patterns:
            post, _ = reliabilities(patterns, np.array([groups[kind, v] for v in patterns], float))
            out.update(zip(((kind, v) for v in patterns), post.tolist(), strict=True))
    return out


def classifier(traits_of: list[list[int]], y: np.ndarray, steps: int = 50, ridge: float = 0.5) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression of posteriors on features, by Newton's method with a ridge."""
    x = np.zeros((len(y), FEATURES + 1))
    for i, t in enumerate(traits_of):
        x[i, t] = 1
    x[:, -1] = 1
    w = np.zeros(FEATURES + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-6:
            break
    return w


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, per_kind: int = PER_KIND) -> DataFrame:
    """Spans of personal data in whole texts: id, n_email, n_ip, n_card, n_phone, base_sha256 and found.

    found: array of (kind, s, e, base, votes, score), start and end in code points, end exclusive, by start then
    kind. Base spans always stay. Candidates of looser patterns (spelled-out e-mails, national phone numbers,
    card-like numbers, names, identity numbers, credentials) stay when the span classifier gives threshold or more.

    Six labelers vote on every span: strict pattern, check digits, gazetteer, context, counter-context, shape. The counts
    of (kind, votes) over all spans, at most 7 * 3^6 groups at any size, go to the driver, where EM estimates each
    labeler's reliability kind by kind. The classifier, a logistic regression on the span's form and the words around it
    (FEATURES hashed features, no votes), is fitted to the posteriors of at most per_kind spans a kind (smallest hash of id
    and place) and scores every candidate. Spans without texts are checkpointed; nothing of a text is shuffled.

    Null and empty texts have no span; repeated rows, ties and null ids pass row by row; an empty table gives an empty
    result. Very long texts: every pattern takes time in proportion to the text, whatever it holds. Columns other than the
    id and text are not read, so they cannot clash.
    """
    bound_batches(docs.sparkSession)
    run, schema = _find(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema}"))
    each = rows.select(F.col(id_col).cast("string").alias("i"), F.explode("found").alias("f"))
    groups = each.groupBy("f.kind", "f.votes").count().collect()
    post = posteriors({(r.kind, r.votes): r["count"] for r in groups})
    sample = None
    for k in sorted({r.kind for r in groups}):
        part = each.where(F.col("f.kind") == k).select("f.kind", "f.votes", "f.traits", F.xxhash64("i", "f.s", "f.e").alias("h")).orderBy("h", "votes").limit(per_kind)
        sample = part if sample is None else sample.unionByName(part)
    fitted = sorted((r.kind, r.h, r.votes, list(r.traits)) for r in sample.collect()) if sample is not None else []
    w = classifier([t for *_, t in fitted], np.array([post[k, v] for k, _, v, _ in fitted]))
    weights = F.array(*[F.lit(float(x)) for x in w[:-1]])
    z = lambda f: F.aggregate(F.array_sort(f["traits"]), F.lit(float(w[-1])), lambda a, t: a + F.get(weights, t))
    scored = F.transform("found", lambda f: F.struct(f["s"].alias("s"), f["kind"].alias("kind"), f["e"].alias("e"), f["base"].alias("base"), f["votes"].alias("votes"), (1 / (1 + F.exp(-z(f)))).alias("score")))
    return rows.withColumn("found", F.array_sort(F.filter(scored, lambda f: f["base"] | (f["score"] >= threshold))))


def op3(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("found", lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["s"].cast("string"), f["e"].cast("string"))), ",")
    added = lambda k: F.size(F.filter("found", lambda f: ~f["base"] & (f["kind"] == k))).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), added(SECRET).alias("n_secret"), F.size("found").cast("long").alias("n_spans"))
