"""Content scan of text columns: which classes of private material occur, never the value."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Markers that must not occur in published text, matched in lower case.
MARKERS = {
    "private identifier-mapping field": (
        "internal_source_address", "public_source_address", "mapping_file", "mapping_path",
    ),
    "release-key field or file marker": (
        "key_file", "key_path", "key_hex", "secret_key", "private_key", "release.key",
    ),
    "raw capture field": (
        "raw_mac_address", "destination_address", "frame_bytes", "packet_bytes", "bssid", "ssid",
    ),
}

# Patterns of addresses, tokens and credentials.
PATTERNS = {
    "MAC-like value": r"(?i)(?<![0-9a-f])(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}(?![0-9a-f])",
    "private-key block": r"(?i)-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "AWS access token": r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])",
    "GitHub access token": r"(?i)(?:github_pat_[a-z0-9_]{20,}|gh[opusr]_[a-z0-9_]{20,})",
    "Google API token": r"AIza[0-9A-Za-z_-]{35}",
    "Slack access token": r"xox[baprs]-[0-9A-Za-z-]{20,}",
    "credential-bearing URL": r"(?i)https?://[^/\s:@]{1,64}:[^/\s@]{4,}@",
    "assigned credential or key material": (
        r"(?i)(?<![a-z0-9_])(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|"
        r"password|passwd|private[_-]?key|deployment[_-]?key|release[_-]?key)(?![a-z0-9_-])"
        r"""\s*["']?\s*[:=]\s*["']?(?:[0-9a-f]{32,}|[a-z0-9+/=_-]{24,})"""
    ),
}


# What a text must hold for a pattern to match at all, in lower case, all groups and any word of each.
NEEDS = {
    "MAC-like value": ((":", "-"),),
    "private-key block": (("-----begin ",),),
    "AWS access token": (("akia",),),
    "GitHub access token": (("github_pat_", "gho_", "ghp_", "ghu_", "ghs_", "ghr_"),),
    "Google API token": (("aiza",),),
    "Slack access token": (("xox",),),
    "credential-bearing URL": (("://",),),
    "assigned credential or key material": (("=", ":"), ("key", "token", "passw")),
}
# A cheaper pattern that a match of the pattern holds; tried on the lower-case text before the pattern itself.
FIRST = {"MAC-like value": r"[0-9a-f]{2}[:-][0-9a-f]{2}[:-]"}


def _any(text, words):
    """Whether the text holds one of the words; words that hold a rare sign they share are tried only where it is found."""
    def one_of(some):
        found = F.contains(text, F.lit(some[0]))
        for word in some[1:]:
            found = found | F.contains(text, F.lit(word))
        return found

    joined, rest = [w for w in words if "_" in w and w != "_"], [w for w in words if "_" not in w]
    rest = [w for w in rest if not any(o != w and o in w for o in rest)]    # a word that holds another one adds nothing
    groups = [one_of(rest)] if rest else []
    if joined:
        groups.append(F.contains(text, F.lit("_")) & one_of(joined))
    return groups[0] if len(groups) == 1 else groups[0] | groups[1]


def content_findings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class) for every class found in a whole text, in one pass: literals are searched first, and a pattern runs only on
    texts that hold what it needs."""
    low = F.col("_low")
    hits = [F.when(_any(low, words), F.lit(name)) for name, words in MARKERS.items()]
    for name, pattern in PATTERNS.items():
        found = F.lit(True)
        for words in NEEDS[name]:
            found = found & _any(low, words)
        if name in FIRST:
            found = found & low.rlike(FIRST[name])
        hits.append(F.when(found & F.col("_text").rlike(pattern), F.lit(name)))
    rows = texts.select(F.col(key).alias(key), F.col(text).alias("_text"), F.lower(F.col(text)).alias("_low"))
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("finding"))


def content_scan(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Number of texts with a finding, by class."""
    return content_findings(texts, key, text).groupBy("finding").agg(F.count("*").alias("n_texts"))
