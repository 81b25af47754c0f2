"""How typed entities are written."""

#: Parts of the patterns.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MOBILE = r"(?:\+?977[-\s]?)?9[678][0-9]{8}"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
QUALIFIER = r"(?:[ \t]*(?:no|number|num|code|id|#)\b\.?)?"
GAP = r"[^\S\n]*[:#.\-)\]]*[^\S\n]*\n?[^\S\n]*"
PROSE = r"[^0-9\n]{0,40}\n?[^0-9\n]{0,25}"
WALLET = f"({MOBILE}|{MAIL})"
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
NAME = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"
#: Endings that make a bare name a domain; what ends a sentence and not a value.
ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "np", "in", "uk", "us", "au", "de", "fr", "cn", "jp", "ru", "top", "xyz",
           "site", "online", "shop", "store", "app", "dev", "ai", "me", "tv", "cc", "link", "click", "live", "vip", "pro", "asia")
CLOSING = ".,;:!?)]}'\"।"
#: The pattern of each entity type and the groups that hold the value (0: all of it). One form per type
#: that Java and RE2 read alike where there is no look-around.
PATTERNS: dict[str, dict[str, tuple[str, tuple[int, ...]]]] = {
    "network": {
        "urls": (r"(?i)\b(?:https?://|www\.)[^\s<>\"'\x{0900}-\x{097F}]+", (0,)), "ipv4": (rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", (0,)), "mac_addresses": (r"\b[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})\b", (0,)), "cve_ids": (r"(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b", (0,)),
        "ports": (r"(?i)\bport\s*(?:no\.?|number)?\s*[:#]?\s*([0-9]{1,5})\b|\b(?:[a-z0-9-]*[a-z][a-z0-9-]*(?:\.[a-z0-9-]+)*|[0-9]{1,3}(?:\.[0-9]{1,3}){3}):([0-9]{2,5})(?=[/\s,]|$)", (1, 2)),
        "domains": (rf"(?i)[@/.]{NAME}|\b({NAME})", (1,)),
        "ipv6": (r"(?<![\w:.])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![\w:])|(?<![\w:.])([0-9A-Fa-f:]*::[0-9A-Fa-f:]*)(?![\w:.])", (1, 2)),
    },
    "contact": {"emails": (rf"\b{MAIL}\b", (0,)), "phones": (rf"{MOBILE}\b|\b0[0-9]{{1,2}}[-\s]?[0-9]{{6,7}}\b|\+[0-9]{{1,3}}[-\s]?[0-9]{{6,12}}\b", (0,))},
    "temporal": {
        "dates": (rf"(?i)\b[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}\b|\b[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{2,4}}\b|\b{MONTHS}\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}\b|\b[0-9]{{1,2}}(?:st|nd|rd|th)?\s+{MONTHS}\.?,?\s+[0-9]{{4}}\b", (0,)),
        "times": (r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\s?(?:AM|PM|am|pm)?\b", (0,)),
    },
    "financial": {
        "money": (r"(?i)(?:NPR|Rs\.?|रु\.?|₹|\$|USD|INR|EUR|GBP|£|€)\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?|[0-9][0-9,]*(?:\.[0-9]{1,2})?\s?(?:NPR|USD|INR|EUR|GBP|rupees|rupaiya|paisa|dollars?)", (0,)),
        "bank_accounts": (r"(?i)(?:a/c|acc?(?:oun)?t|khata|खाता)" + QUALIFIER + GAP + r"([0-9][0-9\- ]{7,24}[0-9])", (1,)), "card_numbers": (r"\b(?:[0-9][ -]?){12,18}[0-9]\b", (0,)),
        "transaction_ids": (r"(?i)\b(?:transaction|txn|trxn|tranx|voucher|receipt|reference|ref|invoice|order|bill|payment)\b" + QUALIFIER + GAP + r"([A-Za-z0-9][A-Za-z0-9._/-]{4,29})|(\b[0-9]{3,6}(?:\.[0-9]{3,6}){2}\b)|(\b[A-Za-z]{2,5}-[0-9]{2,4}(?:-[0-9]{2,6}){1,3}\b)", (1, 2, 3)),
        "otp": (r"(?i)(?:\botp\b|\bcode\b|\bpin\b|\bpassword\b|ओटीपी)[^0-9]{0,12}?(?<![\d-])([0-9]{4,8})(?![\d-])", (1,)),
        "esewa_ids": (r"(?i)\be[\s-]?sewa\b" + QUALIFIER + GAP + WALLET + r"|\be[\s-]?sewa\b" + PROSE + f"({MOBILE})", (1, 2)),
        "khalti_ids": (r"(?i)\bkhalti\b" + QUALIFIER + GAP + WALLET + r"|\bkhalti\b" + PROSE + f"({MOBILE})", (1, 2)),
        "imepay_ids": (r"(?i)\bime[\s-]?pay\b" + QUALIFIER + GAP + WALLET + r"|\bime[\s-]?pay\b" + PROSE + f"({MOBILE})", (1, 2)),
    },
    "crypto": {
        "hashes_sha512": (r"\b[a-fA-F0-9]{128}\b", (0,)), "hashes_sha256": (r"\b[a-fA-F0-9]{64}\b", (0,)), "hashes_sha1": (r"\b[a-fA-F0-9]{40}\b", (0,)), "hashes_md5": (r"\b[a-fA-F0-9]{32}\b", (0,)),
        "eth_wallets": (r"\b0x[a-fA-F0-9]{40}\b", (0,)), "btc_wallets": (r"\b(?:bc1[ac-hj-np-z02-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", (0,)),
    },
    "social": {
        "social_media_urls": (r"(?i)\b(?:https?://)?(?:www\.)?(?:facebook\.com|fb\.com|fb\.me|instagram\.com|t\.me|telegram\.me|wa\.me|api\.whatsapp\.com|twitter\.com|x\.com|tiktok\.com|youtube\.com|youtu\.be)/[^\s<>\"']+", (0,)),
        "telegram_usernames": (r"(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me)/([A-Za-z][A-Za-z0-9_]{4,31})|(?:^|[\s(])@([A-Za-z][A-Za-z0-9_]{4,31})\b", (1, 2)), "whatsapp_numbers": (r"(?i)(?:https?://)?wa\.me/(\+?[0-9]{8,15})|\bwhats\s?app\b[^0-9]{0,12}(" + MOBILE + r"|\+[0-9]{8,15})", (1, 2)),
        "facebook_usernames": (r"(?i)(?:https?://)?(?:www\.)?(?:facebook\.com|fb\.com)/(?!share|groups|pages|watch|events)([A-Za-z0-9.]{5,50})", (1,)), "instagram_usernames": (r"(?i)(?:https?://)?(?:www\.)?instagram\.com/([A-Za-z0-9_.]{2,30})", (1,)),
    },
}

#: How dates and times are written in documents, chats and file metadata.
LABELLED_TIME = (r"(?im)^[ \t]*(?:date(?:\s*(?:&|and)\s*time)?|timestamp|time|date\s+of\s+[A-Za-z][A-Za-z0-9 _/&-]{0,30}|"
                 r"[A-Za-z][A-Za-z0-9 _/&-]{0,30}\s+(?:date(?:\s*(?:&|and)\s*time)?|timestamp|time))[ \t]*(?::[ \t]*|\r?\n[ \t]*)([^\r\n]{1,100})")
ISO_TIME = r"(?i)(?<![0-9])([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})(?:[ T]?)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*(am|pm)?\b"
VISIBLE_DATES = (r"(?<![0-9])[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}(?![0-9])", r"(?<![0-9])[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}(?![0-9])",
                 r"(?i)\b[0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\s+[0-9]{4}\b", r"(?i)\b[A-Za-z]{3,9}\s+[0-9]{1,2}(?:st|nd|rd|th)?,?\s+[0-9]{4}\b")
VISIBLE_TIME = r"(?i)(?<![0-9])([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:am|pm)?)(?![0-9])"
CHAT_FULL = r"(?i)(?<![0-9])[\[(]?\s*([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\s*,?\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*(am|pm)?\s*[\])]?\s*(?![0-9])"
CHAT_PARTIAL = r"([0-9]{1,2})-([0-9]{1,2})\s*,\s*([0-9]{1,2}):([0-9]{2})(?::\w+)?"
PDF_TIME = r"^D:([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:(Z)|([+-])([0-9]{2})'?([0-9]{2})'?)?"
