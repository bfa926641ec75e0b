"""Plain-Python readings of sequential operators, to compare small inputs with."""

import math
import re

from signalloom import fixed_values as V


def tokens(text):
    text = re.sub("['’]", "", (text or "").lower())
    words = re.sub("[^a-z0-9]+", " ", text).strip().split(" ")
    return {w for w in words if len(w) >= 3 and w not in V.STOP_WORDS}


def phrases(title):
    return {m.lower() for m in re.findall(V.NAME_PHRASE, title or "", re.ASCII)}


def nouns(text, regex):
    found = {m.group(0).lower() for m in re.finditer(regex, text, re.I | re.ASCII)}
    return {V.OBJECT_SPELLINGS.get(n, n) for n in found}


def action_of(text, rules):
    for name, regex in rules:
        if re.search(regex, text, re.I | re.ASCII):
            return name
    return None


def entity_ids(text, entities):
    from signalloom.operators.entities import entity_pattern

    return {e["id"] for e in entities if re.search(entity_pattern(e["match"]), text, re.I | re.ASCII)}


def group(items, threshold, entities=(), actions=V.ACTION_RULES, strong=V.STRONG_OBJECTS):
    """Founder index of every item (dicts in pool order)."""
    n = len(items)
    df = {}
    feats = []
    for it in items:
        both = f"{it['title']} {it['desc'] or ''}"
        f = dict(
            t=tokens(it["title"]), d=tokens(it["desc"]), p=phrases(it["title"]), date=it["published_at"],
            cat=it.get("category"), act=action_of(both, actions), ents=entity_ids(both, entities),
        )
        f["o"] = f["p"] | nouns(both, strong)
        for s in (f["t"], f["d"]):
            for tok in s:
                df[tok] = df.get(tok, 0) + 1
        feats.append(f)
    idf = {k: math.log((n + 1) / (c + 0.5)) + 1 for k, c in df.items()}

    def wj(a, b):
        if not a or not b:
            return 0.0
        return sum(sorted(idf[x] for x in a & b)) / sum(sorted(idf[x] for x in a | b))

    def oc(a, b):
        return len(a & b) / min(len(a), len(b)) if a and b else 0.0

    def score(x, y):
        content = 0.5 * wj(x["t"], y["t"]) + 0.3 * oc(x["p"], y["p"]) + 0.2 * wj(x["d"], y["d"])
        hours = abs((x["date"] - y["date"]).total_seconds()) / 3600
        ent = len(x["ents"] & y["ents"]) / len(x["ents"] | y["ents"]) if x["ents"] and y["ents"] else 0.0
        ov = oc(x["o"], y["o"])
        if x["act"] and y["act"] and x["act"] != y["act"] and ov < 0.6:
            return min(content, 0.15)
        same = x["act"] and x["act"] == y["act"]
        if hours <= 72 and ((same and ov > 0) or (ov >= 0.5 and ent > 0)):
            return max(content, 0.55)
        if content < 0.02:
            return content
        cat = 1 if x["cat"] and x["cat"] == y["cat"] else 0
        return content + (0.4 * ent + 0.35 * min(1, max(0, 1 - hours / 48)) + 0.25 * cat) * min(content, 0.5) * 1.4

    groups, founder = [], []
    for i, f in enumerate(feats):
        best, at = -1.0, None
        for g in groups:
            s = score(feats[g["rep"]], f)
            if s > best + 1e-12:  # sums differ in the last bits between engines
                best, at = s, g
        if at is not None and best >= threshold:
            founder.append(at["first"])
            if f["date"] < feats[at["rep"]]["date"]:
                at["rep"] = i
        else:
            groups.append(dict(first=i, rep=i))
            founder.append(i)
    return founder, {g["first"]: g["rep"] for g in groups}
