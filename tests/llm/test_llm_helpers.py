"""Brute-force versions that several tests share."""

import re


def survivors(texts, words, percent):
    """Ids left by the first three stages: with a letter, first of equal texts, first of their near copies."""
    kept, seen = {}, set()
    for i in sorted(texts):
        text = texts[i]
        if text is None or not any(c.isalpha() for c in text):
            continue
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        if plain not in seen:
            seen.add(plain)
            kept[i] = text
    sets = {}
    for i, text in kept.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} or {tuple(own)}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {x: a if y == b else y for x, y in label.items()}
    return {i for i, a in label.items() if a == i}
