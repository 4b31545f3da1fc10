"""Small inputs with every awkward case, and plain versions of the operators to hold results against."""

import random
import re

WORDS = "alder birch cedar ebony fir hazel ivy juniper larch maple oak pine rowan spruce willow yew".split()


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(f"{pick.choice(WORDS)}{pick.randrange(400)}" for _ in range(words))


def awkward() -> list[tuple]:
    """(doc_id, text, n, digest): nulls, empty, blank, very long, ties, copies, other scripts; two columns with inner names."""
    base = prose(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    texts = [None, "", " \n\t ", "one", "One", base, base, near, base.upper(), prose(2, 4000), "ümläut 漢字 🦙 é", "a\n\n\nb\n", " x\x1fy", prose(3, 90)]
    return [(i * 3 + 1, t, i, f"d{i}") for i, t in enumerate(texts)] + [(None, base, 0, "none"), (5000, prose(3, 90), 1, None), (5000, prose(3, 90), 1, None)]


SCHEMA = "doc_id long, text string, n long, digest string"


def shingles(text: str | None, size: int = 4) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + min(size, len(words))]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def groups(sets: dict, percent: int = 85) -> dict:
    """Smallest key reachable by links."""
    keys = sorted(sets)
    label = {k: k for k in keys}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {k: top(k) for k in keys}


def without_runs(docs: list[tuple[int, str]], least: int) -> dict:
    """Lines that lie in a run of whole lines of `least` words that stands earlier, removed; the slow way."""
    seqs = {d: [(p, line) for p, line in enumerate(t.split("\n")) if re.search(r"[^ \t\x0b\f\r]", line)] for d, t in docs}
    seen, dead = set(), {d: set() for d, _ in docs}
    for d, _ in sorted(docs):
        lines = seqs[d]
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(re.findall(r"[^ \t\x0b\f\r]+", lines[j][1]))
                if words >= least:
                    run = tuple(x for _, x in lines[i:j + 1])
                    if run in seen:
                        dead[d].update(range(lines[i][0], lines[j][0] + 1))
                    else:
                        seen.add(run)
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in dead[d]) for d, t in docs}
