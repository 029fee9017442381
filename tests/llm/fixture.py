"""A small table with every case that the operators define, and plain versions of what they compute."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents() -> list[tuple]:
    """Prose with copies, near copies, shared passages, repeats, long, empty and null texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdehilmnorstué") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.06 else "") for _ in range(n))
    passage, base = prose(70), prose(160)
    texts = [prose(rng.randrange(25, 140)) for _ in range(14)]
    texts += [base, base, base.replace(vocabulary[3], "other"), base + " tail of its own", prose(20) + "\n" + passage + "\n" + prose(30), passage, prose(15) + " " + passage]
    texts += ["", None, " \t\n", "one", "Two words", "x " * 9000 + prose(50), "# % & " * 60, "same line here\n" * 12, prose(3000)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b")[i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[2], (rows[5][0], prose(60), "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def order(i: int | None) -> float:
    return float("inf") if i is None else i


def removed_words(rows: list[tuple], size: int = 50) -> list[list[str]]:
    """Kept words of each row: those that no window covers which an earlier id has too."""
    first: dict[tuple, float] = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, float("inf")), order(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < order(i):
                gone.update(range(k, k + size))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def shingles(text: str | None, size: int) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows: list[tuple], size: int = 2, percent: int = 80) -> dict[int, int]:
    """id -> least reachable id, by all pairs; rows of one id are one document."""
    sets = [(i, shingles(t, size)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def kept_lines(rows: list[tuple], least: int) -> list[list[str] | None]:
    """Lines of each distinct row without later copies of runs."""
    distinct = sorted({(order(i), str(t), t) for i, t, *_ in rows if t is not None})
    if len({(o, t) for o, _, t in distinct}) != len({o for o, *_ in distinct}):
        distinct = sorted(distinct)
    first: dict[tuple, tuple] = {}
    for o, s, t in distinct:
        lines = t.split("\n")
        for k in range(len(lines) - least + 1):
            first.setdefault(tuple(lines[k : k + least]), (o, s, k))
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append(None)
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - least + 1):
            if first[tuple(lines[k : k + least])] != (order(i), str(t), k):
                gone.update(range(k, k + least))
        out.append([x for k, x in enumerate(lines) if k not in gone])
    return out


def quality(text: str | None) -> tuple:
    w, lines = words(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    repeated = {p for places in at.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def multiset(rows) -> Counter:
    return Counter(rows)
