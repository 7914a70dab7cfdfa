"""Plain-Python versions of the operators' contracts, and awkward inputs."""
import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s1")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward():
    long_ = " ".join(f"w{i % 977} part{i % 31}," for i in range(4000))
    para = "the same paragraph of text is repeated here and there, " * 9
    return [
        (1, "Some plain words.\nShared line of text here\nLast one"),
        (2, "Shared line of text here\n  shared LINE of text here \nOwn line, quite different"),
        (3, None), (4, ""), (5, " \n\t\n"), (None, "no id\nShared line of text here"),
        (6, long_), (7, long_ + " tail"), (8, para), (9, "x" + para + "y"), (9, "x" + para + "y"),
        (10, "a" * 1500), (11, "Éàü ñandú ça\nÉÀÜ ÑANDÚ ça va bien"), (12, "éàü ñandú ça va\r\nx"),
        (13, "one two three " * 40, None, None), (14, "one two three " * 40, "de", None),
        (15, "$$$ ### %% " * 60, "en", "s2"), (15, "other text with the same id", "en", "s2"),
    ]


def lines(rows):
    def key(s):
        s = s.strip(SPACES)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    ident = lambda d: (1 << 63) - 1 if d is None else d
    where = defaultdict(set)
    for d, t, *_ in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                where[key(s)].add(ident(d))
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        keep = [s for s in ls if len(key(s)) < 10 or len(where[key(s)]) < 2
                or min(where[key(s)]) == ident(d)]
        out.append((d, len(ls), len(ls) - len(keep),
                    hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def substrings(rows, min_len, keep="none"):
    texts = [(t or "").encode() for _, t, *_ in rows]
    where = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        for s in range(len(texts[i]) - min_len + 1):
            where[texts[i][s:s + min_len]].append((i, s))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, s in (places[1:] if keep == "first" else places):
                gone[i][s:s + min_len] = b"\1" * min_len
    out = []
    for (d, *_), t, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((d, len(t), sum(g), len(re.findall(b"\1+", bytes(g))),
                    hashlib.sha256(kept).hexdigest()))
    return out


def quality_base(text):
    w = WORD.findall(text or "")
    windows = defaultdict(int)
    for i in range(len(w) - 2):
        windows[tuple(w[i:i + 3])] += 1
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for s in (text or "").split("\n"):
        if WORD.search(s):
            dup += s in seen
            seen.add(s)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def crc_kind(conv, turn):
    import zlib
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    return zlib.crc32(key.encode()) % 20


def damaged(rows):
    """(conv, turn, role, text) rows after damage; and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc_kind(conv, turn)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, {r[0] for r in rows}


def repaired_turns(faulty):
    """((cost, audit), lines) of [(role, text, fault)], by all edits at every
    state; faults: blank, duplicate, truncated or None."""
    from functools import cache
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, added):
        ways = []
        if i == len(faulty) and state in ("", "a"):
            ways.append((0, "", ()))
        if added < 3:
            c, a, x = best(i, due[state], added + 1)
            ways.append((c + 2, "I" + a, (full[due[state]] + ":", *x)))
        if i < len(faulty):
            role, text, fault = faulty[i]
            c, a, x = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, x))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                initial = role[:1]
                if initial == due[state] or (initial == "s" and state == ""):
                    c, a, x = best(i + 1, initial, 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = best(i + 1, due[state], 0)
                ways.append((c + 2 + more, "R" + a, (f"{full[due[state]]}:{text}", *x)))
        return min(ways, key=lambda w: w[:2], default=(1 << 30, "", ()))

    return best(0, "", 0)


def conversations(rows):
    """The result of op11 for undamaged rows."""
    after, convs = damaged(rows)
    out = []
    for conv in convs:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            solid = text.strip(SPACES)
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        cost, audit, lines = repaired_turns(tuple(faulty))
        count = lambda f: sum(x[2] == f for x in faulty)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faulty, faulty[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"),
                    count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
