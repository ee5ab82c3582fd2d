"""Small editorial dimensions used with the sample tables: rules, profiles, topics.

A deployment passes its own; nothing in the operators depends on these entries.
"""

from __future__ import annotations

RULES = [
    {"id": "r01", "weight": 100, "groups": [["thanedble", "thanea"]], "topics": ["core"], "query": "thanedble OR thanea", "exploration": False},
    {"id": "r02", "weight": 95, "groups": [["the"], ["attion", "retion"]], "topics": ["core", "funding"], "query": "attion retion", "exploration": False},
    {"id": "r03", "weight": 90, "groups": [["eauouon", "leau"], ["les", "des"]], "topics": ["core"], "query": "leau eauouon", "exploration": False},
    {"id": "r04", "weight": 85, "groups": [["und"], ["keit", "heit", "ung"]], "topics": ["core", "policy"], "query": "heit keit", "exploration": False},
    {"id": "r05", "weight": 80, "groups": [["para", "con"], ["ado", "aci"]], "topics": ["core", "policy"], "query": "para con", "exploration": False},
    {"id": "r06", "weight": 75, "groups": [["token", "secret", "password"]], "topics": ["policy", "core"], "query": "token secret", "exploration": False},
    {"id": "r07", "weight": 70, "groups": [["that the", "of the"]], "topics": ["funding", "policy"], "query": "of the", "exploration": False},
    {"id": "r08", "weight": 65, "groups": [["license", "copyright"]], "topics": ["policy"], "query": "license", "exploration": False},
    {"id": "r09", "weight": 60, "groups": [["with"], ["for"], ["in"]], "topics": ["funding"], "query": "with for in", "exploration": False},
    {"id": "r10", "weight": 50, "groups": [["einer", "eine"], ["der", "die"]], "topics": ["funding"], "query": "eine der", "exploration": False},
    {"id": "r11", "weight": 40, "groups": [["thble"]], "topics": ["core", "funding"], "query": "thble", "exploration": True},
    {"id": "r12", "weight": 30, "groups": [["ouan"], ["onpa", "que"]], "topics": ["core", "funding", "policy"], "query": "ouan", "exploration": True},
]
EXCLUDED = ["asthnt", "spam"]
PROFILES = [
    {"profile_id": "research", "interests": ["attion", "that the", "und", "eauouon"], "exclude": ["password"], "picks": 3},
    {"profile_id": "market", "interests": ["thanedble", "of", "eine", "para"], "exclude": ["license"], "picks": 3},
    {"profile_id": "watch", "interests": ["token", "les", "with"], "exclude": [], "picks": 3},
]
PRODUCT_NAMES = {"src1": "First Product", "src2": "Second Product"}
TOPICS = {"core": "new", "funding": "rounds", "policy": "standards"}
REPO_PROFILE = {"interests": ["widget", "bolt", "ring"], "exclude": ["rusty"], "picks": 3}
CHANNELS = ["news", "blogs", "academic", "products", "security"]
