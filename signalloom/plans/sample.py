"""Lexicons for the given tables, whose invented prose has none of the news words.

They exercise the operators with words that do occur; shapes are those of
:mod:`signalloom.fixed_values`.
"""

CATEGORIES = {
    "policy": [(r"\bthon\b", 2), (r"\bthor\w*\b", 1.5), (r"\bque\b", 1)],
    "orggov": [(r"\bthan\b", 2), (r"\beren?\b", 1)],
    "capital": [(r"\bthre\b", 1.5), (r"\bthnd\b", 2.5)],
    "compute": [(r"\bthing\b", 2), (r"\banea\b", 1.5)],
    "opensource": [(r"\blicen[cs]e\b", 3), (r"\bthes\b", 1)],
    "research": [(r"\bthtion\b", 2), (r"\berst\b", 1.5)],
    "market": [(r"\berat\b", 2), (r"\bonan\b", 1.5)],
    "adoption": [(r"\bthly\b", 1), (r"\bthou\b", 1.5)],
    "analysis": [(r"\bund\b", 2.5), (r"^\s*(the|and|in|of)\b", 1.5)],
    "product": [(r"\bdes\b", 1.5), (r"\belle\b", 2)],
}
ACTIONS = [
    ("shutdown", r"\b(thion|than)\b"), ("resign", r"\bthnd(s|t)?\b"), ("launch", r"\b(erea|ering)\b"),
    ("sue", r"\bque\b"), ("research", r"\b(onan|onth)\b"),
]
STRONG = r"\b(thre|thor|anea|eron|ontion)\b"
WEAK = r"\b(erst|erth|onre)\b"
LABS = [("openai", r"\b(thing|onst)\b"), ("google", r"\bereat?\b"), ("meta", r"\belle\b")]
LAB_NAMES = ["openai", "google", "anthropic"]
FIELDS = [("Robotics", r"\b(thst|thou)"), ("Biology", r"\b(onen|erin)\b"), ("Vision", r"\bder\b")]
SHIPPING = r"\b(thre|erti|onre|erly|que)\b"
QUESTION = r"^\s*(the|to|by|de|la)\b"
HEDGING = r"\b(thst|ondre|les)\b"
JOB = r"\b(erin|thsh)\b"
SPECULATIVE = r"\b(thti|anon) ?\w*\b"
OFFICIAL = ["src0", "src7"]
TOPICS = [
    ("coding", "Coding", r"\b(thre|thin)\b"), ("speed", "Speed", r"\b(erth|than)\b"),
    ("price", "Price", r"\bder\b|\bque\b"), ("local", "Local use", r"\b(thon|thor)\b"),
    ("safety", "Safety", r"\bon(re|an|st)\b"),
]
RELEASE_TALK = r"\b(the|that|de|la|is)\b"
CONTEXT = r"\b(and|with|der|les)\b"
MATCHERS = {
    "alpha": dict(strong=[r"\bther\b", r"\bthth\b"], org=r"\bfrom\b", version=r"\bthre?\b", product=r"\bare\b"),
    "beta": dict(strong=[r"\berer\b"], base=r"\ber\b", org=r"\bund\b", ambiguous=True, reject=r"\bthe\s+er\b"),
    "gamma": dict(strong=[r"\bque\b", r"\bdes\b"], org=r"\bles\b"),
}
ENTITIES = [
    dict(id="e-than", importance=95, match=["than", "thth"]),
    dict(id="e-elle", importance=70, match=["elle"]),
    dict(id="e-thre", importance=60, match=[r"\bthre(s|d)?\b"]),
    dict(id="e-on", importance=40, match=["on of", "on the"]),
    dict(id="e-none", importance=99, match=["nowhere-to-be-found"]),
]
VIDEO_CONTEXT = ["than", "elle"]
VIDEO_OFF_TOPIC = ["thor", "que"]
AS_OF = "2024-01-31 00:00:00"
