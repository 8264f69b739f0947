"""Small corpora with the awkward cases, and helpers that several tests share."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, size long, bucket string, "
          "row string, n_words string, rank int, marks string")
SPACES = " \t\n\x0b\f\r"


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def rows(texts, sources=None):
    """Rows of SCHEMA whose extra columns clash with names that operators use inside."""
    out = []
    for i, text in enumerate(texts):
        source = sources[i] if sources else f"s{i % 3}"
        out.append((i, text, "en", source, len(text or ""), "k", 7, "b", "r", "w", 1, "m"))
    return out


def corpus(seed=1, count=60):
    """Prose, exact and near copies, shared passages, and null, empty, odd and long texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "x y", "Ω"]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage = prose(70)
    texts = [None, "", SPACES, "one", "two words", "a b c d", "A B C D", "a b c d e", "same " * 120]
    for _ in range(count):
        base = prose(r.choice((5, 60, 120, 200)))
        texts.append(base)
        kind = r.random()
        if kind < 0.2:
            texts.append(base)
        elif kind < 0.6:
            changed = base.split(" ")
            for _ in range(max(1, len(changed) // r.choice((15, 30, 60)))):
                changed[r.randrange(len(changed))] = r.choice(vocabulary)
            texts.append(" ".join(changed))
        elif kind < 0.8:
            texts.append(prose(30) + "\n" + passage + "\t" + prose(20))
    texts.append(passage + " " + passage)
    texts.append(prose(20_000))
    texts.append(texts[-1].replace("w1 ", "w2 "))
    r.shuffle(texts)
    return texts
