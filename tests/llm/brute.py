"""Plain Python twins of the corpus operators."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(UP))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def neardup(rows, width, percent):
    """{doc_id: (n, component)} of rows (doc_id, text) with ids."""
    sets = {d: shingle_set(t, width) for d, t in rows if d is not None}
    label = {d: d for d in sets}
    ids = sorted(sets)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contamination(text, items, width=13):
    w = TOKEN.findall((text or "").translate(UP))
    hit, found = set(), set()
    for name, item in items:
        x = TOKEN.findall((item or "").translate(UP))
        n = min(width, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(name)
    ids = ",".join(sorted(str(f) for f in found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    cover = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def targets(sizes, weights, share=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, left, out = share * sum(sizes.values()), set(names), {}
    while left:
        even = rest / sum(w[s] for s in left)
        over = [s for s in left if even * w[s] > limit * sizes[s]]
        if not over:
            return out | {s: even * w[s] for s in left}
        for s in over:
            out[s] = limit * sizes[s]
            rest -= out[s]
            left.discard(s)
    return out


def repeats(rows, depth):
    """[(doc_id, n, removed, spans, sha)] of rows (doc_id, bytes): earlier is a smaller id (null last), or the same row."""
    big = 2**63 - 1
    first = {}
    for d, b in rows:
        for i in range(len(b) - depth + 1):
            k = b[i : i + depth]
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for d, b in rows:
        hit, own = bytearray(len(b)), set()
        for i in range(len(b) - depth + 1):
            k = b[i : i + depth]
            if first[k] < (big if d is None else d) or k in own:
                hit[i : i + depth] = b"\1" * depth
            own.add(k)
        left = bytes(c for c, h in zip(b, hit) if not h)
        spans = len(re.findall(b"\1+", bytes(hit)))
        out.append((d, len(b), sum(hit), spans, hashlib.sha256(left).hexdigest()))
    return out


def secret_spans(text):
    kinds = [
        ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    out = [(m.start(), k, name, m.end()) for k, (name, r, ok) in enumerate(kinds) for m in r.finditer(text or "") if ok(m)]
    return [f"{n}:{s}:{e}" for s, _, n, e in sorted(out)]


def plain_guess_cost(value, rank, secrets):
    """The cheapest segmentation, every segment tried."""
    low = value.lower() if len(value.lower()) == len(value) else value
    leet = low.translate(secrets._PLAIN)
    best = [0.0] + [math.inf] * len(value)
    for i, c in enumerate(value):
        steps = [(i + 1, 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33))]
        for j in range(i + 3, len(value) + 1):
            known, swapped = rank.get(low[i:j]), rank.get(leet[i:j])
            if known or swapped:
                steps.append((j, math.log10((known or swapped) * (2 if low[i:j] != value[i:j] else 1) * (1 if known else 2)) + 0.3))
            if len(set(value[i:j])) == 1:
                steps.append((j, math.log10(40 * (j - i))))
            if all(secrets._near(a, b) for a, b in zip(low[i:j], low[i + 1 : j])):
                steps.append((j, math.log10(47 * (j - i)) + 0.3 * (j - i)))
        if m := secrets._DATE.match(value, i):
            steps.append((m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120)))
        for j, cost in steps:
            best[j] = min(best[j], best[i] + cost)
    return best[-1]


def credential_name(name):
    """Cuts a name into words letter by letter."""
    words, word = [], ""
    for i, c in enumerate(name):
        up, low = c in string.ascii_uppercase, c in string.ascii_lowercase
        after = name[i + 1 : i + 2]
        if up and word and (word[-1].islower() or (after and after in string.ascii_lowercase)):
            words.append(word)
            word = ""
        if up or low:
            word += c
        elif word:
            words.append(word)
            word = ""
    words = [w.lower() for w in [*words, word] if w]
    words = [w if w == "pass" or not w.endswith("s") else w[:-1] for w in words]
    whole = "password passwd passphrase passcode pass pwd secret token credential auth authorization authentication".split()
    ends = "password passwd passphrase passcode pwd secret token credential apikey accesskey secretkey privatekey authkey".split()
    return bool(words) and (words[-1] == "key" or any(w in whole or any(w[-len(e) :] == e for e in ends) or any(w[: len(e)] == e for e in ("password", "passwd", "passphrase", "pwd")) for w in words))


def plain_value(text, k):
    """(start, end) of the value at k."""

    def scheme(k, stop):
        j = k
        while j < stop and text[j] in string.ascii_letters:
            j += 1
        e = j
        while e < stop and text[e] in " \t":
            e += 1
        ok = text[k:j].lower() in ("bearer", "basic", "digest", "token", "negotiate", "apikey", "bot") and e > j and e < len(text) and not text[e].isspace()
        return e if ok else k

    n = len(text)
    k = scheme(k, n)
    q = text[k : k + 1]
    if q and q in "\"'`":
        e = k + 1
        while e < n and text[e] != q and text[e] not in "\n\r":
            e += 2 if text[e] == "\\" and text[e + 1 : e + 2] not in ("", "\n", "\r") else 1 if text[e] != "\\" else n
        if e < n and text[e] == q:
            return (scheme(k + 1, e) if scheme(k + 1, e) <= e else k + 1), e
        k += 1
    if text[k : k + 1] and text[k] in "[{(" and (k + 1 == n or text[k + 1].isspace() or text[k + 1] in "\"'`[{("):
        return k, k
    opened, e = [], k
    while e < n and not text[e].isspace():
        c = text[e]
        if c in "([{<":
            opened.append(c)
        elif c in ")]}>":
            o = "([{<"[")]}>".index(c)]
            if o in opened:
                while opened.pop() != o:
                    pass
            elif c != ">":
                break
        e += 1
    return k, e


def all_spans(text, rank, secrets):
    """kind:start:end of base spans and of guessed ones: names and values are read character by character."""
    text, name = text or "", set(string.ascii_letters + string.digits + "_.-")
    base = [s.split(":") for s in secret_spans(text)]
    covered = {i for _, s, e in base for i in range(int(s), int(e))}
    found, i, n = [], 0, len(text)
    while i < n:
        if text[i] not in name or (i and text[i - 1] in name):
            i += 1
            continue
        j = i
        while j < n and text[j] in name:
            j += 1
        k = j + (j < n and text[j] in "\"'`")
        k += text[k : k + 1] == "]"
        while k < n and text[k] in " \t":
            k += 1
        sign = next((x for x in (":=", "=>", ":", "=") if text.startswith(x, k)), None)
        if sign is None:
            i = j
            continue
        k += len(sign)
        while k < n and text[k] in " \t":
            k += 1
        if not credential_name(text[i:j]):
            i = k
            continue
        s, e = plain_value(text, k)
        value = text[s:e]
        if value and not set(range(s, e)) <= covered and not secrets._ELSEWHERE.fullmatch(value):
            if plain_guess_cost(value, rank, secrets) >= secrets.least_cost(value):
                found.append((s, 3, f"guess:{s}:{e}"))
        i = max(k, e)
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    spans = [(int(s), order[k], f"{k}:{s}:{e}") for k, s, e in base] + found
    return [x for _, _, x in sorted(spans)]


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return host.translate(UP), re.split(r"[?#]", rest[len(host) :])[0]


def kneser_ney(texts, discounts, order):
    """Probability of a word after the order - 1 tokens before it; None is the end, "" the begin."""
    counts = {order: Counter()}
    for t in texts:
        line = [*[""] * (order - 1), *t, None]
        counts[order].update(tuple(line[i : i + order]) for i in range(len(t) + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts([sum(n == x for n in c.values()) for x in (1, 2, 3, 4)]) for k, c in counts.items()}
    after = defaultdict(list)
    for c in counts.values():
        for g, n in c.items():
            after[len(g), g[:-1]].append(n)
    total = {x: sum(n) for x, n in after.items()}
    left = {(k, h): sum(d[k][min(x, 3) - 1] for x in n) for (k, h), n in after.items()}
    v = len({w for t in texts for w in t}) + bool(texts)

    def p(context, w):
        low = 1 / (v + 1)
        for k in range(1, order + 1):
            h = tuple(context[len(context) - k + 1 :])
            if (k, h) in total:
                n = counts[k][*h, w]
                low = (max(n - (0, *d[k])[min(n, 3)], 0) + left[k, h] * low) / total[k, h]
        return low

    return p


def token_bytes(path):
    """Bytes of each id of a byte-level BPE in JSON, or of a sentencepiece model."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("\u2581", " ").encode() for i in range(m.vocab_size())]
    from tokenizers import Tokenizer, decoders

    t, d = Tokenizer.from_file(path), decoders.ByteLevel()
    shown = [t.id_to_token(i) for i in range(t.get_vocab_size())]
    table = {}
    for b in range(256):  # what stands for a byte is what the tokenizer itself writes for it
        c = t.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] if b < 128 else None
        if c:
            table[c] = b
    table |= {c: ord(c) for c in "".join(shown) if c not in table and ord(c) < 256}
    rest = sorted({c for c in "".join(shown) if c not in table}, key=ord)
    free = sorted(set(range(256)) - set(table.values()))
    assert len(rest) <= len(free) and d
    order = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    table |= {c: order[ord(c) - 256] for c in rest if ord(c) - 256 < len(order)}
    return [bytes(table.get(c, 63) for c in s) for s in shown]


def alignment(rows, a_path, b_path):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] of rows (doc_id, text), byte by byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a_tok.encode_special_tokens = True
    a_bytes, b_bytes = token_bytes(a_path), token_bytes(b_path)
    docs, count = [], Counter()
    for d, t in rows:
        raw, groups, pairs = (" " + (t or "")).encode(), [], []
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        if not t or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            docs.append((d, [], [], [], []))
            continue
        at_a, at_b = [k for k, i in enumerate(a) for _ in a_bytes[i]], [k for k, i in enumerate(b) for _ in b_bytes[i]]
        seen = sorted(set(zip(at_a, at_b)))
        pairs = [(a[x], b[y]) for x, y in seen]
        group = ([], [])
        for i in range(len(raw)):
            last_a, last_b = i + 1 == len(raw) or at_a[i + 1] != at_a[i], i + 1 == len(raw) or at_b[i + 1] != at_b[i]
            if last_a:
                group[0].append(a[at_a[i]])
            if last_b:
                group[1].append(b[at_b[i]])
            if last_a and last_b:
                groups.append(group)
                group = ([], [])
        count.update(pairs)
        docs.append((d, a, b, groups, pairs))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for d, a, b, groups, pairs in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def vocabulary(rows, drop=97):
    """Counter of the runs of rows (doc_id, text), some of which lose a letter."""
    import zlib

    out = Counter()
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            out[w if h % drop else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 5 and n >= 3})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants(count, ratio=2):
    """{word: (form, root, n, n_near, form_n)}: words that share what is left after one deletion are compared letter by letter."""
    share = defaultdict(set)
    for w in count:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            share[k].add(w)
    near = defaultdict(set)
    for some in share.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * n else None
    out = {}
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out
