"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from patterns, with places by code points: a text is split at the matches of a pattern,
and running sums of the lengths of pieces and matches give every start and end. Seven labelers vote on
each candidate: its format, a gazetteer, cue words before it, cue words after it, counter-cues on both
sides, the characters that frame it, and the company of other kinds in the document. No candidate needs
a vote to be one, so every group holds what nothing speaks for. Expectation-maximisation over the counts
of vote patterns, of which there is a bounded number, estimates each labeler's reliability; a
candidate's probability under it is its soft label. A logistic span classifier is fitted on these
labels, one group of candidates at a time, from the candidate and its surroundings: length, character
classes, the check of its format (the one vote among them), the characters on either side and the word
before it, hashed. So it can follow words that are in no list, and refuse what its words speak against. It is
applied as a SQL expression. Spans of the base patterns always stay; the classifier adds spans that no
base span overlaps: spelled-out addresses, national phone numbers, secrets, bank accounts, identity
numbers and names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: In the order in which spans of one start are listed. The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "id", "name")
BASE = KINDS[:4]
# A match can only begin where a run of its first class begins or where the last match ended, so each
# pattern says so: without that, a long run without a match would be tried from every character.
# Possessive repeats change no match here and need no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++(?:\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "national": r"\([0-9]{2,5}\)[\x20-]?[0-9](?:[\x20.-]?[0-9])++",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}+=?=?",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}\p{N}'-])(?:\p{Lu}[\p{Ll}'-]++\x20){1,2}\p{Lu}[\p{Ll}'-]++",
}
GUARDS = {
    "email": "contains(text, '@')",
    "phone": "contains(text, '+')",
    "spelled": "contains(text, '(at)') or contains(text, '[at]') or contains(text, ' dot ')",
    "ip": r"text rlike '[0-9]\\.[0-9]'",
    "card": r"text rlike '[0-9][\\x20-]?[0-9]'",
    "national": r"text rlike '\\([0-9]{2,5}\\)'",
    "secret": "text rlike '[A-Za-z0-9_+/-]{16}'",
    "account": "text rlike '[A-Z]{2}[0-9]{2}'",
    "id": "text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
    "name": r"text rlike '\\p{Lu}[\\p{Ll}\'-]++\\x20\\p{Lu}[\\p{Ll}\'-]'",
}
KIND_OF = {"spelled": "email", "national": "phone", "digits": "phone"}
#: Candidates that the label model takes together: those of one pattern; runs of digits too short for a card are apart.
GROUPS = (*PATTERNS, "digits")
# Word lists of the gazetteer and context labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|example"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
CALLING = r"1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
TOKENS = "akia|asia|ghp_|gho_|glpat-|sk-|sk_|pk_|xox[abp]-|aiza|ya29|eyj"
IBAN_COUNTRIES = "at|be|ch|cz|de|dk|es|fi|fr|gb|ie|it|lu|nl|no|pl|pt|se"
FIRST_NAMES = (
    "james|john|robert|michael|william|david|richard|joseph|thomas|charles|mary|patricia|jennifer|linda|elizabeth|barbara|susan|jessica|sarah|karen|"
    "hans|peter|klaus|wolfgang|jürgen|stefan|andreas|anna|maria|ursula|monika|petra|sabine|claudia|jean|pierre|michel|philippe|alain|marie|nathalie|isabelle|"
    "sylvie|catherine|josé|antonio|manuel|francisco|juan|carmen|ana|isabel|dolores|pilar|paul|mark|daniel|laura|emma|julia"
)
BEFORE = {
    "email": "mail|e-mail|contact|kontakt|correo|courriel|write to|from|cc|reach me at",
    "ip": "ip|host|server|address|adresse|from|client|login",
    "card": "card|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta|pan",
    "phone": "tel|tél|phone|call|mobil|mobile|cell|fax|telefon|teléfono|téléphone|whatsapp|sms",
    "secret": "token|secret|password|passwd|pwd|passwort|api.?key|access.?key|auth|bearer|private.?key|credentials?",
    "account": "iban|account|konto|compte|cuenta|bank",
    "id": "ssn|social security|passport|tax id|steuer-id|dni|nif",
    "name": "mr|mrs|ms|dr|prof|herr|frau|señor|señora|sr|sra|monsieur|madame|mme|name is|i am|ich bin|je suis|soy|dear|contact|author|signed|sincerely|regards",
}
AFTER = {
    "email": "wrote|schrieb|or call|for questions",
    "ip": "port|logged|connected|login",
    "card": "exp|expires|valid|cvv|cvc|gültig|caduca",
    "phone": "ext|extension|durchwahl|or mail|mobile|anytime",
    "secret": "expires|revoked?|rotate|keep it|do not share",
    "account": "bic|swift|bank",
    "id": "issued|expires|born|dob",
    "name": "said|says|wrote|born|aged|sagte|schrieb|a dit|dijo|lives|works|phd|esq",
}
COUNTER = r"isbn|issn|doi|version|order|invoice|ref|commit|sha-?1|sha-?256|md5|hash|checksum|digest|uuid|serial|build|page|line|#|\\$|€"
UNITS = r"usd|eur|€|\\$|%|kg|km|items|pages|bytes"
PLACES = "university|institute|street|avenue|license|licence|public|general|inc|ltd|gmbh|corporation|united|north|south|new|january|february|march|april|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
#: Code points of context on either side, up to the next match of the same pattern.
CONTEXT = 32
#: Probability from which the classifier adds a span.
ADD_AT = 0.8
#: Hashed words before a candidate, and the number of values of each feature of the classifier.
WORDS = 64
FEATURES = {"size": 5, "mix": 3, "check": 3, "left": 4, "right": 4, "word": WORDS}
LABELERS = ("v_format", "v_gazetteer", "v_before", "v_after", "v_counter", "v_frame", "v_company")
BLOCK = 64
#: Code points of a block of text that redaction looks pieces up in.
PIECE = 512


def _before(values: str, over: str) -> str:
    """SQL: ``over`` (of a and x, 0 for none) of all numbers before each entry of an array column, in blocks: blocks first, then their entries.

    Entries are taken by their place, since a slice copies the whole array.
    """
    block = f"sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK - 1}, size({values}) - 1))"
    blocks = f"sequence(0, greatest(size({values}) - 1, 0) div {BLOCK})"
    wholes = f"transform({blocks}, b -> aggregate({block}, 0L, (a, i) -> {over.format(a='a', x=f'{values}[i]')}))"
    first = f"if(b = 0, 0L, aggregate(sequence(0, b - 1), 0L, (a, i) -> {over.format(a='a', x='w[i]')}))"
    inner = f"""aggregate({block}, named_struct('at', {first}, 'all', cast(array() as array<bigint>)),
        (s, i) -> named_struct('at', {over.format(a='s.at', x=f'{values}[i]')}, 'all', array_append(s.all, s.at)), s -> s.all)"""
    # An array of one entry binds w, so that the blocks are summed up once.
    return f"if(size({values}) = 0, cast(array() as array<bigint>), flatten(transform(array({wholes}), w -> flatten(transform({blocks}, b -> {inner})))))"


def running(lengths: str) -> str:
    """SQL: sums before each entry of an array column."""
    return _before(lengths, "{a} + {x}")


def highest(values: str) -> str:
    """SQL: the greatest number before each entry of an array column, 0 before the first."""
    return _before(values, "greatest({a}, {x})")


def _digits(x: str) -> str:
    return f"translate({x}, ' ().+-', '')"


def _luhn(d: str) -> str:
    return f"""(aggregate(sequence(1, length({d})), 0L, (a, i) -> a + case when (length({d}) - i) % 2 = 0
        then cast(substring({d}, i, 1) as int)
        else (2 * cast(substring({d}, i, 1) as int)) div 10 + (2 * cast(substring({d}, i, 1) as int)) % 10 end) % 10 = 0)"""


def _mod97(x: str) -> str:
    """The check of bank accounts: the first four characters last, letters as 10 to 35, remainder 1."""
    moved = f"concat(substring(translate({x}, ' ', ''), 5), left({x}, 4))"
    return f"""(aggregate(split({moved}, ''), 0L, (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as int)) % 97
        else (a * 100 + ascii(c) - 55) % 97 end) = 1)"""


VALID = {
    "email": "true",
    "ip": "forall(split(x.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": f"case when length({_digits('x.hit')}) between 14 and 19 then {_luhn(_digits('x.hit'))} else false end",
    "phone": f"length({_digits('x.hit')}) between 10 and 15",
}


def _matches(df: DataFrame) -> DataFrame:
    """Adds m_<pattern>: array of (start, end, hit, before, after) for each pattern; null where there is none."""
    text = F.col("text")
    df = df.withColumns({f"g_{k}": F.when(F.expr(GUARDS[k]), F.split(text, PATTERNS[k], -1)) for k in PATTERNS})
    df = df.withColumns({f"h_{k}": F.when(F.size(f"g_{k}") > 1, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k in PATTERNS})
    df = df.withColumns({f"l_{k}": F.expr(f"transform(h_{k}, (x, i) -> cast(length(g_{k}[i]) + length(x) as bigint))") for k in PATTERNS})
    df = df.withColumns({f"p_{k}": F.when(F.col(f"l_{k}").isNotNull(), F.expr(running(f"l_{k}"))) for k in PATTERNS})
    struct = f"named_struct('start', p_{{k}}[i] + length(g_{{k}}[i]), 'end', p_{{k}}[i] + l_{{k}}[i], 'hit', x, 'before', lower(right(g_{{k}}[i], {CONTEXT})), 'after', lower(left(g_{{k}}[i + 1], {CONTEXT})))"
    df = df.withColumns({f"m_{k}": F.expr(f"transform(h_{k}, (x, i) -> {struct.format(k=k)})") for k in PATTERNS})
    return df.drop(*(f"{a}_{k}" for a in "ghlp" for k in PATTERNS))


def _labels(pattern: str) -> dict[str, str]:
    """SQL of each labeler's vote on a candidate x of ``pattern``: 1 (personal), -1 (not) or 0 (no opinion)."""
    d, low = _digits("x.hit"), "lower(x.hit)"
    n = f"length({d})"
    three = lambda yes, no="false": f"case when {yes} then 1 when {no} then -1 else 0 end"
    # A run long enough for a card that fails its check digit is most likely another number; a shorter one has no check.
    format_ = {
        "email": "1",
        "ip": three(VALID["ip"], "true"),
        "card": three(VALID["card"], f"{n} >= 14"),
        "phone": three(VALID["phone"], f"{n} < 10 or {n} > 19"),
        "spelled": three("x.hit rlike '[(\\\\[]'"),
        "national": three(f"{n} between 9 and 13", "true"),
        "secret": three("length(x.hit) >= 20"),
        "account": three(_mod97("x.hit"), "true"),
        "id": three("not x.hit rlike '^(000|666|9)|-00-|0000$'", "true"),
        "name": "0",
    }[pattern]
    gazetteer = {
        "email": three(f"{low} rlike '[.]({DOMAINS})$'", "true"),
        # A plain word "at" something "dot com" may be prose.
        "spelled": three(f"{low} rlike '({DOMAINS})$' and x.hit rlike '[0-9(._\\\\[-]'", f"not {low} rlike '({DOMAINS})$'"),
        "ip": three("not x.hit rlike '^(0|22[4-9]|2[3-5][0-9])[.]'", "true"),
        "card": three(f"{n} >= 14 and {d} rlike '^({ISSUERS})' or {n} < 14 and {d} rlike '^0[1-9]'", f"{n} >= 14"),
        "phone": three(f"{d} rlike '^({CALLING})'", "true"),
        "national": three(f"{d} rlike '^0?[1-9]'", "true"),
        "secret": three(f"{low} rlike '^({TOKENS})'"),
        "account": three(f"{low} rlike '^({IBAN_COUNTRIES})'", "true"),
        "id": "0",
        "name": three(f"{low} rlike '(^| )({FIRST_NAMES}) '", f"{low} rlike '(^| )({PLACES})( |$)'"),
    }[pattern]
    kind = KIND_OF.get(pattern, pattern)
    cue = lambda words: f"x.before rlike '(^|[^\\\\p{{L}}0-9])({words})( (is|was|no|number|nr))?[^\\\\p{{L}}0-9]*$'"
    before = three(cue(BEFORE[kind]))
    if pattern == "card":  # short runs of digits are phone numbers, if anything
        before = f"case when {n} >= 14 then {before} else {three(cue(BEFORE['phone']))} end"
    after = three(f"x.after rlike '^[^\\\\p{{L}}0-9]*({AFTER[kind]})([^\\\\p{{L}}]|$)'")
    counter = three("false", f"{cue(COUNTER)} or x.after rlike '^[^\\\\p{{L}}0-9]*({UNITS})([^\\\\p{{L}}]|$)'")
    glued = r"x.before rlike '[\\p{L}0-9_]$' or x.after rlike '^[\\p{L}0-9_]'"
    frame = {
        "email": three(r"x.before rlike '([<(:\"]|mailto:)\\x20?$'"),
        "secret": three(r"x.before rlike '[:=]\\x20?[\"\']?$'"),
        "name": three("false", r"x.before rlike '(^|[.!?:])[^\\p{L}0-9]*$'"),
    }.get(kind, f"case when {glued} then -1 when x.before rlike '[:(#]\\\\x20*$' then 1 else 0 end")
    return {"v_format": format_, "v_gazetteer": gazetteer, "v_before": before, "v_after": after, "v_counter": counter, "v_frame": frame}


def _votes(pattern: str) -> str:
    """SQL fields of one candidate x of ``pattern``."""
    d = _digits("x.hit")
    n = f"length({d})"
    kind, group = str(KINDS.index(KIND_OF.get(pattern, pattern))), str(GROUPS.index(pattern))
    if pattern == "card":
        kind, group = f"case when {n} >= 14 then {kind} else {KINDS.index('phone')} end", f"case when {n} >= 14 then {group} else {GROUPS.index('digits')} end"
    numeric = pattern in ("ip", "card", "phone", "national", "id")
    size = f"case when {n} < 10 then 0 when {n} < 13 then 1 when {n} < 16 then 2 when {n} = 16 then 3 else 4 end"
    size = size if numeric else "case when length(x.hit) < 8 then 0 when length(x.hit) < 16 then 1 when length(x.hit) < 24 then 2 when length(x.hit) < 40 then 3 else 4 end"
    mix = r"case when not x.hit rlike '\\p{L}' then 0 when x.hit rlike '[0-9]' then 2 else 1 end"
    labels = _labels(pattern)
    votes = ", ".join(f"'{v}', {sql}" for v, sql in labels.items())
    side = "case when {x} = '' then 0 when {x} rlike '^[\\\\p{{L}}\\\\p{{N}}_]$' then 1 when {x} rlike '^[\\\\s]$' then 2 else 3 end"
    word = r"regexp_extract(x.before, '(\\p{L}+)( (is|was|no|number|nr))?[^\\p{L}0-9]*$', 1)"
    word = f"case when {word} = '' then 0 else cast(1 + crc32(encode({word}, 'UTF-8')) % {WORDS - 1} as int) end"
    seen = f"'size', {size}, 'mix', {mix}, 'check', {labels['v_format']} + 1, 'left', {side.format(x='right(x.before, 1)')}, 'right', {side.format(x='left(x.after, 1)')}, 'word', {word}"
    return f"named_struct('kind', {kind}, 'grp', {group}, 'start', x.start, 'end', x.end, 'base', {VALID.get(pattern, 'false')}, {votes}, 'v_company', 0, {seen})"


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``found``: every candidate of ``text`` with its votes.

    A base match or national phone number that fails its check is no candidate, but for runs of 10 digits or more;
    those too short for a card stand free of letters. All other matches of all patterns are candidates, whatever the votes.
    """
    df = _matches(df)
    df = df.withColumns({f"c_{k}": F.when(F.col(f"m_{k}").isNotNull(), F.expr(f"transform(m_{k}, x -> {_votes(k)})")) for k in PATTERNS}).drop(*(f"m_{k}" for k in PATTERNS))
    keep = {"email": "x.base", "ip": "x.base", "phone": "x.base", "card": "x.base or x.kind = 2 or x.size >= 1 and x.v_frame >= 0", "national": "x.v_format > 0"}
    fields = ",".join(f"{v}:int" for v in LABELERS)
    kind = f"array<struct<kind:int,grp:int,start:bigint,end:bigint,base:boolean,{fields},{','.join(f'{c}:int' for c in FEATURES)}>>"
    parts = [F.coalesce(F.expr(f"filter(c_{k}, x -> {keep.get(k, 'true')})").cast(kind), F.expr(f"cast(array() as {kind})")) for k in PATTERNS]
    df = df.withColumn("found", F.concat(*parts)).drop(*(f"c_{k}" for k in PATTERNS))
    # company: valid matches of other kinds in the document
    df = df.withColumn("sizes", F.array(*(F.expr(f"size(filter(found, x -> x.base and x.kind = {i}))") for i in range(len(KINDS)))))
    df = df.withColumn("all_sizes", F.expr("aggregate(sizes, 0, (a, x) -> a + x)"))
    same = ", ".join(f"'{c}', x.{c}" for c in ("kind", "grp", "start", "end", "base", *LABELERS[:-1]))
    seen = ", ".join(f"'{c}', x.{c}" for c in FEATURES)
    company = "case when all_sizes > sizes[x.kind] then 1 else 0 end"
    return df.withColumn("found", F.expr(f"transform(found, x -> named_struct({same}, 'v_company', {company}, {seen}))")).drop("sizes", "all_sizes")


# --------------------------------------------------------------------------- label model and classifier
#: Share of each group's candidates that are personal, before any is seen.
PRIOR = dict(zip(GROUPS, (0.7, 0.6, 0.5, 0.6, 0.5, 0.5, 0.3, 0.3, 0.3, 0.3, 0.3)))
#: How labelers are thought to vote (-1, 0, 1) before any vote is seen, on what isn't personal and what is; check digits err less than words.
VOTES = dict.fromkeys(LABELERS, ((0.4, 0.5, 0.1), (0.1, 0.4, 0.5))) | {"v_format": ((0.7, 0.2, 0.1), (0.02, 0.38, 0.6))}
#: What these beliefs weigh, as a share of a group's candidates, and at least.
BELIEF, LEAST_BELIEF = 0.1, 10.0
#: What the classifier's weights are drawn to 0 by, in candidates.
RIDGE = 1.0
_FIRST = dict(zip(FEATURES, np.cumsum([1, *FEATURES.values()]).tolist()))
_EACH = 1 + sum(FEATURES.values())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30.0, 30.0)))


def estimate(patterns: list[dict], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(odds of a group, gain of a group, labeler and vote, counts of these by truth): EM over counted vote patterns, from the majority vote on.

    A candidate's log-odds are its group's odds and the gains of its votes.
    """
    grp = np.array([p["grp"] for p in patterns], int)
    votes = np.array([[p[v] + 1 for v in LABELERS] for p in patterns], int).reshape(-1, len(LABELERS))
    n = np.array([p["n"] for p in patterns], float)
    belief = np.maximum(LEAST_BELIEF, BELIEF * np.bincount(grp, n, len(GROUPS)))
    prior_, votes_ = np.array([(1 - x, x) for x in PRIOR.values()]), np.array([VOTES[v] for v in LABELERS]).transpose(0, 2, 1)
    post = _sigmoid(1.5 * (votes - 1).sum(1))
    for _ in range(rounds):
        prior, table = belief[:, None] * prior_, belief[:, None, None, None] * votes_
        for truth, w in ((0, n * (1 - post)), (1, n * post)):
            np.add.at(prior[:, truth], grp, w)
            for i in range(len(LABELERS)):
                np.add.at(table[:, i, :, truth], (grp, votes[:, i]), w)
        share = table / table.sum(2, keepdims=True)
        odds, gain = np.log(prior[:, 1] / prior[:, 0]), np.log(share[..., 1] / share[..., 0])
        new = _sigmoid(odds[grp] + gain[grp[:, None], np.arange(len(LABELERS)), votes].sum(1))
        moved = np.abs(new - post).max(initial=0.0)
        post = new
        if moved < 1e-6:
            break
    return odds, gain, table


def fit(seen: list[dict], rounds: int = 30) -> list[float]:
    """Weights of a logistic classifier of each group, by Newton's method, on counted features: ``n`` candidates, ``q`` of them personal."""
    weights = np.zeros((len(GROUPS), _EACH))
    for k in sorted({p["grp"] for p in seen}):
        own = [p for p in seen if p["grp"] == k]
        n, q = np.array([p["n"] for p in own], float), np.array([p["q"] for p in own], float)
        x = np.zeros((len(own), _EACH))
        x[:, 0] = 1.0
        for name, first in _FIRST.items():
            x[np.arange(len(own)), first + np.array([p[name] for p in own], int)] = 1.0
        pull = np.full(_EACH, RIDGE)
        pull[0] = 1e-3
        w = weights[k]
        loss = lambda w: float((n * np.logaddexp(0, x @ w) - q * (x @ w)).sum() + (pull * w * w).sum() / 2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30.0, 30.0)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * p - q) + pull * w)
            size, before = 1.0, loss(w)
            while size > 1e-4 and loss(w - size * step) > before:
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        weights[k] = w
    return weights.ravel().tolist()


def features(p) -> list[int]:
    """Places of the classifier's features of a candidate; each group has its own."""
    return [p["grp"] * _EACH, *(p["grp"] * _EACH + first + p[name] for name, first in _FIRST.items())]


def _picked(values, index: str) -> str:
    return f"element_at(array({', '.join(f'{float(v)!r}D' for v in values)}), {index} + 1)"


def _soft(odds: np.ndarray, gain: np.ndarray) -> str:
    """SQL: the label model's probability of a candidate, in millionths, so that sums are exact."""
    of = lambda k: " + ".join([f"{float(odds[k])!r}D", *(_picked(gain[k, i], f"{v} + 1") for i, v in enumerate(LABELERS))])
    return f"cast(round(1e6D / (1D + exp(-(case grp {' '.join(f'when {k} then {of(k)}' for k in range(len(GROUPS)))} end)))) as bigint)"


def train(found: DataFrame) -> list[float]:
    """The classifier's weights, from written candidates. The driver sees one row a group and vote pattern, at most 11 x 3**7, and one a
    group and set of features, at most 11 x 46,080; both are bounded by the labelers and features, not by the texts."""
    each = found.select(F.explode("found").alias("x")).select("x.*")
    patterns = [r.asDict() for r in sorted(each.groupBy("grp", *LABELERS).agg(F.count("*").alias("n")).collect())]
    odds, gain, _ = estimate(patterns)
    seen = each.groupBy("grp", *FEATURES).agg(F.count("*").alias("n"), (F.sum(F.expr(_soft(odds, gain))) / 1e6).alias("q"))
    return fit([r.asDict() for r in sorted(seen.collect())])


def _probability(weights: list[float], x: str) -> str:
    branches = []
    for k in range(len(GROUPS)):
        w = weights[k * _EACH : (k + 1) * _EACH]
        branches.append(f"when {k} then " + " + ".join([f"{float(w[0])!r}D", *(_picked(w[first : first + FEATURES[c]], f"{x}.{c}") for c, first in _FIRST.items())]))
    return f"(1D / (1D + exp(-(case {x}.grp {' '.join(branches)} end))))"


def decided(found: DataFrame, weights: list[float]) -> DataFrame:
    """Adds ``base`` and ``spans``, each sorted by start and kind."""
    order = "array_sort(transform({what}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))"
    found = found.withColumn("base", F.expr(order.format(what="filter(found, x -> x.base)")))
    found = found.withColumn("more", F.expr(f"filter(found, x -> not x.base and {_probability(weights, 'x')} >= {ADD_AT!r}D)"))
    # A span overlaps a base span where, of those that begin before its end, one ends after its start: one sort and a running maximum.
    event = "transform({of}, x -> named_struct('at', x.{at}, 'own', {own}, 'start', x.start, 'kind', x.kind, 'end', x.end))"
    events = f"array_sort(concat({event.format(of='base', at='start', own=1)}, {event.format(of='more', at='end', own=0)}))"
    found = found.withColumn("events", F.when(F.size("more") > 0, F.expr(events)))
    found = found.withColumn("ends", F.expr("transform(events, x -> if(x.own = 1, x.end, 0L))"))
    # The running maximum is bound by an array of one entry: written into the filter it would be taken for every event.
    added = order.format(what=f"flatten(transform(array({highest('ends')}), r -> filter(events, (x, i) -> x.own = 0 and r[i] <= x.start)))")
    spans = f"case when events is null then base else array_sort(concat(base, {added})) end"
    return found.withColumn("spans", F.expr(spans)).drop("more", "events", "ends", "found")


_NAMES = f"array({', '.join(repr(k) for k in KINDS)})"


def _joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', element_at({_NAMES}, x.kind + 1), x.start, x.end)), ',')")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Counts and ``base_sha256`` (of ``kind:start:end`` by start and kind, comma-joined; code points, end
    exclusive) cover the base patterns' matches that pass their checks; ``spans`` lists these and what the
    classifier adds, further kinds after the four; ``n_spans`` is their number. Added spans overlap no base span but may overlap each
    other. Null and empty texts have none. One row for each input row, repeated or not; other columns are
    left aside. An empty table gives an empty result.
    """
    found = materialize(candidates(docs.select("doc_id", "text")).drop("text"), "candidates")
    done = decided(found, train(found))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return done.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars`` counted anew; all other columns stay.

    Overlapping spans: the earlier one's kind stands for what it covers, the rest of the later one goes too.
    """
    # Written with its candidates, so that the patterns are tried once.
    found = materialize(candidates(docs.select(F.struct("*").alias("row"), "text")).drop("text"), "candidates")
    done = decided(found, train(found) if weights is None else weights).withColumn("text", F.col("row.text"))
    # Where the text before each span was last covered, and the text in blocks, so that a piece is not looked for from the start.
    done = done.withColumn("ends", F.when(F.size("spans") > 0, F.expr("transform(spans, x -> x.end)")))
    done = done.withColumn("covered", F.when(F.size("spans") > 0, F.expr(highest("ends"))))
    done = done.withColumn("blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    piece = f"substring(array_join(transform(sequence(int({{a}} div {PIECE}), int({{b}} div {PIECE})), j -> get(blocks, j)), ''), int({{a}} % {PIECE}) + 1, int({{b}} - {{a}}))"
    before = piece.format(a="covered[i]", b="x.start")
    tail = piece.format(a="array_max(ends)", b="length(text)")
    cut = f"concat(array_join(transform(spans, (x, i) -> case when x.start >= covered[i] then concat({before}, '[', upper(element_at({_NAMES}, x.kind + 1)), ']') else '' end), ''), {tail})"
    done = done.withColumn("text", F.when(F.size("spans") > 0, F.expr(cut)).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return done.select([new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
