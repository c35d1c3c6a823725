"""Brute-force scoring of single texts in plain Python, for comparison with the Spark operators."""

import re

from legajo.rules import patterns, suppliers, types


def keyword(text):
    lower = (text or "").lower()
    opening = " ".join(lower.split()[:100])
    best, score = "desconocido", 0.0
    for name, words in types.TYPE_KEYWORDS.items():
        points = 0.0
        for w in words:
            points += lower.count(w) * 0.1 + (0.3 if w in opening else 0.0)
        points = min(points, 1.0)
        if points > score:
            best, score = name, points
    return (best if score >= 0.7 else "desconocido"), score


def regex(text):
    best, score = "desconocido", 0.0
    for name, exprs in patterns.TYPE_PATTERNS.items():
        hits = sum(min(len(re.findall(p, text or "", re.I | re.M)), 3) for p in exprs)
        points = min(hits / (3 * len(exprs)), 1.0)
        if points > score:
            best, score = name, points
    return best, score


def domain(text, rules):
    lower = (text or "").lower()
    best, score = "desconocido", 0.0
    for name, spec in rules.TYPES.items():
        points = sum(rules.POINTS_KEYWORD for k in spec["keywords"] if k in lower)
        points += sum(rules.POINTS_MATCH * len(re.findall(p, lower, re.I)) for p in spec["patterns"])
        found = [e for e in spec["required"] if any(re.search(p, lower, re.I) for p in rules.ELEMENTS[e])]
        points += rules.POINTS_REQUIRED * len(found)
        points = min(points * (0.5 + 0.5 * len(found) / len(spec["required"])), 1.0)
        if points > score:
            best, score = name, points
    if score == 0:
        return best, score
    bonus = sum(
        points for _, points, whole, terms in rules.BONUS for t in terms
        if (re.search(rf"\b{t}\b", lower) if whole else t in lower)
    )
    return best, min(score + min(bonus, rules.BONUS_LIMIT), 1.0)


def supplier(text):
    upper = (text or "").upper()
    best, score = None, 0.0
    for s in suppliers.SUPPLIERS:
        points = 0.0
        if any(n in upper for n in s["names"]):
            points = 0.4
        elif any(len(n) > 10 and len(n.split()) > 1 and sum(w in upper for w in n.split()) >= 2 for n in s["names"]):
            points = 0.3
        points += 0.3 if s["cuit"] in upper else 0.0
        points += max(
            sum(t in upper for t in terms) / len(terms) * 0.2 + sum(i in upper for i in marks) / len(marks) * 0.1
            for _, terms, marks, _ in s["patterns"]
        )
        if min(points, 1.0) > score:
            best, score = s["supplier_id"], min(points, 1.0)
    return (best, score) if score >= 0.3 else (None, 0.0)
