"""Documents with planted toxic texts, copies and passages."""

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu") for b in ("lan", "mer", "sod", "pik", "vu") for c in ("", "s", "ta", "ne", "lo")]
TOXIC = ["idiot", "moron", "scum", "trash"]


def passage_free(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def planted(r):
    docs, labels = [], []
    truth = {"toxic": set(), "clean": set(), "copies": [], "passage": passage_free(r, 70)}

    def add(text):
        docs.append((len(docs), text, "en", f"s{len(docs) % 3}", len(text or ""), "x"))
        return len(docs) - 1

    for i in range(700):
        words = passage_free(r, r.randint(30, 90)).split()
        if i % 4 == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(TOXIC)
            key = add(" ".join(words))
            labels.append((key, 0, 1))
            truth["toxic"].add(key)
        else:
            key = add(" ".join(words))
            labels.append((key, 1, 0))
            truth["clean"].add(key)
    for _ in range(10):
        words = passage_free(r, 200).split()
        group = {add(" ".join(words))}
        for _ in range(r.randint(1, 4)):
            other = list(words)
            if r.random() < 0.7:
                other[r.randrange(200)] = "changed"
            group.add(add(" ".join(other)))
        truth["copies"].append(group)
    for _ in range(5):
        add(f"{passage_free(r, 80)} {truth['passage']} {passage_free(r, 80)}")
    add(None)
    add("")
    return docs, labels, truth
