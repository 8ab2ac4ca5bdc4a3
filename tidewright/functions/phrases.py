"""Phrase rules and word lists of the text audits."""

# Phrases that assert a cause.
CAUSAL = [
    (r"\bcaused?\b", "caused"), (r"\bcausing\b", "causing"), (r"\bbecause\b", "because"), (r"\bdue to\b", "due to"),
    (r"\bdrove\b", "drove"), (r"\bdriven by\b", "driven by"), (r"\btriggered\b", "triggered"), (r"\bled to\b", "led to"),
    (r"\bresulted in\b", "resulted in"), (r"\bas a result of\b", "as a result of"), (r"\bthanks to\b", "thanks to"),
    (r"\bthe reason (?:for|was|is)\b", "the reason for"),
]

# Phrases that give investment advice.
VERDICT = [
    (r"\byou should (?:buy|sell|hold|invest|avoid)\b", "you should buy/sell/hold"), (r"\bwe recommend\b", "we recommend"),
    (r"\bi recommend\b", "i recommend"), (r"\brecommend (?:buying|selling|holding)\b", "recommend buying/selling"),
    (r"\b(?:strong|clear)\s+(?:buy|sell)\b", "strong buy/sell"), (r"\bis a (?:buy|sell)\b", "is a buy/sell"),
    (r"\b(?:buy|sell)\s+rating\b", "buy/sell rating"), (r"\bgood (?:time )?to (?:buy|sell)\b", "good time to buy/sell"),
    (r"\bworth (?:buying|selling)\b", "worth buying/selling"), (r"\bundervalued\b", "undervalued"),
    (r"\bovervalued\b", "overvalued"), (r"\bprice target\b", "price target"),
]

# Verbs of a future move, and phrases that claim certainty.
FUTURE = (
    "go|rise|fall|drop|climb|crash|rally|soar|plunge|recover|double|halve|continue|keep|beat|outperform|underperform|grow|shrink|"
    "rebound|collapse|surge|tank|moon|increase|decrease|gain|lose"
)
CERTAINTY = [
    (rf"\bwill (?:definitely |certainly |surely |likely |probably )?(?:{FUTURE})\b", "will <move>"),
    (rf"\b(?:is|are) going to (?:{FUTURE})\b", "is going to <move>"), (r"\bguarantee(?:d|s)?\b", "guaranteed"),
    (r"\bcertain(?:ly)? to\b", "certain to"), (r"\bdefinitely\b", "definitely"), (r"\b(?:sure|bound) to\b", "sure/bound to"),
    (r"\bno doubt\b", "no doubt"), (r"\bcan(?:no|')t lose\b", "can't lose"), (r"\brisk[- ]free\b", "risk-free"),
    (r"\bwill (?:make|lose) (?:you )?money\b", "will make/lose money"),
]
RULES = (
    [("causal_language", p, n) for p, n in CAUSAL] + [("verdict_language", p, n) for p, n in VERDICT]
    + [("certainty_language", p, n) for p, n in CERTAINTY]
)
# By label, texts of which every match of the rule contains one; a text without them needs no regular expression.
NEEDLES = {
    "caused": ["cause"], "causing": ["causing"], "because": ["because"], "due to": ["due to"], "drove": ["drove"], "driven by": ["driven by"],
    "triggered": ["triggered"], "led to": ["led to"], "resulted in": ["resulted in"], "as a result of": ["as a result of"], "thanks to": ["thanks to"],
    "the reason for": ["the reason "], "you should buy/sell/hold": ["you should "], "we recommend": ["we recommend"], "i recommend": ["i recommend"],
    "recommend buying/selling": ["recommend "], "strong buy/sell": ["strong", "clear"], "is a buy/sell": ["is a buy", "is a sell"],
    "buy/sell rating": ["rating"], "good time to buy/sell": ["to buy", "to sell"], "worth buying/selling": ["worth "], "undervalued": ["undervalued"],
    "overvalued": ["overvalued"], "price target": ["price target"], "will <move>": ["will "], "is going to <move>": [" going to "],
    "guaranteed": ["guarantee"], "certain to": ["certain"], "definitely": ["definitely"], "sure/bound to": ["sure to", "bound to"],
    "no doubt": ["no doubt"], "can't lose": ["t lose"], "risk-free": ["risk-free", "risk free"], "will make/lose money": [" money"],
}

# What is not a numeric claim, in order of removal, and what a number looks like.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
WRITTEN_DATE = rf"(?i)\b(?:\d{{1,2}}\s+(?:{MONTHS})|(?:{MONTHS})\s+\d{{1,2}})(?:,)?(?:\s+\d{{4}})?\b"
DURATION = r"(?i)\b\d{1,3}\s*[-\s]\s*(?:day|week|month|quarter|year)s?\b"
IDENTIFIER = r"\b(?=\w*[A-Za-z_])(?=\w*\d)\w+\b"
RULE_LINE = r"(?m)^[=\-]{3,}$"
LIST_MARKER = r"(?m)^(\s*)\d+\.\s"
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"

# Sections every report carries.
SECTIONS = ["QUESTION", "SUMMARY", "KEY EVIDENCE", "COMPETING EXPLANATIONS", "CONFIDENCE & SAMPLE SIZE", "RAW DATA"]

# Markers of the three kinds of question.
OUTLOOK = [
    r"\bgoing to\b", r"\bgonna\b", r"\boutlook\b", r"\bforecast\b", r"\bpredict(?:ion|ions)?\b", r"\bin the future\b", r"\bfuture of\b",
    r"\bhead(?:ed|ing)\b", r"\bnext (?:week|month|quarter|year)\b",
    r"\bwill\s+\S+\s+(?:go|keep|rise|fall|drop|crash|rally|climb|recover|bounce|be)\b",
    r"\bwill (?:it|they) (?:go|keep|rise|fall|drop|crash|rally|climb|recover|bounce|be)\b",
]
ATTRIBUTION = ["why", "what happened", "what caused", "what drove", "what's behind", "whats behind", "what is behind", "explain", "reason for",
               "cause of", "how come", "what made"]
SNAPSHOT = ["good to invest", "good investment", "worth buying", "worth investing", "should i buy", "should i invest", "should i own", "should i get",
            "is it a buy", "a good buy", "good stock", "tell me about", "what do you think", "look into", "research", "analyze", "analyse",
            "fundamentals", "overview of", "snapshot of", "invest in", "investing in"]

# Phrases that stand for one direction word, and the direction words.
DIRECTION_PHRASES = [
    (r"\bsold\s+off\b", "selloff"), (r"\bsell(?:ing|s)?\s+off\b", "selloff"), (r"\bgave?\s+back\b", "decline"), (r"\bbounced?\s+back\b", "rally"),
    (r"\bwent\s+up\b", "rise"), (r"\bwent\s+down\b", "fall"), (r"\b(?:take|takes|taking|took)\s+off\b", "surge"),
]
DOWN = [
    "fall", "fell", "falling", "falls", "drop", "dropped", "dropping", "drops", "decline", "declined", "declining", "declines", "down", "lower",
    "loss", "losses", "plunge", "plunged", "tank", "tanked", "slide", "slid", "sink", "sank", "sunk", "tumble", "tumbled", "slump", "slumped",
    "crash", "crashed", "sell-off", "selloff", "retreat", "retreated", "dip", "dipped", "weaken", "weakened", "red",
]
UP = [
    "rally", "rallied", "rallying", "rallies", "jump", "jumped", "jumping", "jumps", "rise", "rose", "rising", "rises", "surge", "surged", "soar",
    "soared", "spike", "spiked", "climb", "climbed", "gain", "gained", "gains", "up", "higher", "advance", "advanced", "pop", "popped", "surging",
    "green", "boom", "boomed",
]
