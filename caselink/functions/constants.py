"""Fixed values of the case platform's rules: weights, bands and word lists. Stated as data, in the order of their meaning."""

#: Weight of each linkable entity type.
LINK_WEIGHTS = {
    "phones": 0.90, "whatsapp_numbers": 0.90, "emails": 0.85,
    "wallets": 1.00, "esewa_ids": 1.00, "khalti_ids": 1.00, "imepay_ids": 1.00, "bank_accounts": 1.00, "card_numbers": 1.00,
    "transaction_ids": 0.95, "eth_wallets": 1.00, "btc_wallets": 1.00,
    "social_accounts": 0.80, "telegram_usernames": 0.80, "facebook_usernames": 0.80, "instagram_usernames": 0.80, "social_media_urls": 0.70,
    "urls": 0.75, "domains": 0.60, "mac_addresses": 0.85, "ipv4": 0.60, "ipv6": 0.60,
    "money": 0.20, "otp": 0.25,
}
#: Weight of each factor that isn't an entity type.
FACTOR_WEIGHTS = {"file_hash": 1.00, "device_metadata": 0.70, "image_metadata": 0.50, "timeline_proximity": 0.00, "threat_intelligence": 0.80}
#: The model of a value's specificity, of a pair's confidence and its strength bands (score < bound).
FACTOR_CAP = 3
SPECIFICITY_FLOOR = 0.02
CORPUS_PRIOR = 12.0
FULL_BITS = 40.0
CONFIDENCE_SCALE = 1.6
STRENGTH_BANDS = {"NO_RELATIONSHIP": 0.05, "WEAK": 0.30, "MEDIUM": 0.55, "STRONG": 0.80, "VERY_STRONG": 1.01}
#: Graph node type of each entity type.
NODE_TYPES = {
    "phones": "phone_number", "whatsapp_numbers": "phone_number", "emails": "email", "urls": "url", "domains": "domain",
    "esewa_ids": "wallet", "khalti_ids": "wallet", "imepay_ids": "wallet", "eth_wallets": "wallet", "btc_wallets": "wallet",
    "bank_accounts": "bank_account", "card_numbers": "payment_card", "transaction_ids": "transaction",
    "telegram_usernames": "social_media_account", "facebook_usernames": "social_media_account", "instagram_usernames": "social_media_account",
    "wallets": "wallet", "social_accounts": "social_media_account",
}
#: Campaigns and suspects.
CAMPAIGN_CONFIDENCE = 0.55
IDENTITY_SCORES = {
    "wallets": 100.0, "esewa_ids": 100.0, "khalti_ids": 100.0, "imepay_ids": 100.0, "bank_accounts": 100.0, "card_numbers": 100.0,
    "eth_wallets": 95.0, "btc_wallets": 95.0, "phones": 85.0, "whatsapp_numbers": 85.0, "emails": 75.0,
    "social_accounts": 70.0, "telegram_usernames": 70.0, "facebook_usernames": 70.0, "instagram_usernames": 70.0,
}
SUSPECT_WEIGHTS = {"identity_strength": 0.25, "evidence_count": 0.20, "evidence_confidence": 0.15, "threat_intelligence": 0.15, "correlation_strength": 0.15, "timeline_span": 0.10}
SUSPECT_CONFIDENCE_BANDS = {"VERY_LOW": 20.0, "LOW": 40.0, "MODERATE": 60.0, "HIGH": 80.0, "VERY_HIGH": 101.0}
SUSPECT_RISK_BANDS = {"LOW": 40.0, "MEDIUM": 60.0, "HIGH": 80.0, "CRITICAL": 101.0}
#: Keywords of the five attack stages, in stage order.
STAGE_KEYWORDS = {
    "initial_contact": ("hello", "hi ", "namaste", "dear customer", "offer", "prize", "lottery", "job", "congratulation"),
    "social_engineering": ("urgent", "verify", "suspended", "blocked", "immediately", "warning", "last chance", "expire"),
    "credential_theft": ("password", "otp", "pin", "login", "log in", "credential", "cvv", "security code"),
    "financial_transaction": ("esewa", "khalti", "ime pay", "bank", "transfer", "paid", "payment", "send money", "rs.", "npr", "account number", "wallet"),
    "post_attack": ("blocked me", "deleted", "not responding", "scammed", "fraud", "police", "report", "cheated"),
}
CRITICAL_TYPES = ("otp", "money", "wallets", "esewa_ids", "khalti_ids", "imepay_ids", "bank_accounts", "card_numbers", "transaction_ids")
#: Case priority.
PRIORITY_WEIGHTS = {"evidence_confidence": 0.20, "threat_intelligence": 0.20, "forgery_risk": 0.15, "campaign_size": 0.15, "correlation_strength": 0.15, "timeline_criticality": 0.15}
PRIORITY_BANDS = {"LOW": 30.0, "MEDIUM": 55.0, "HIGH": 75.0, "CRITICAL": 101.0}
#: Keyword groups, their category and their spellings.
KEYWORD_GROUPS = {
    "otp": ("credential", ("otp", "one time password", "ओटीपी")),
    "password": ("credential", ("password", "passworda")),
    "pin": ("credential", ("pin",)),
    "cvv": ("credential", ("cvv", "cvc")),
    "login": ("credential", ("login", "log in", "sign in")),
    "verify": ("credential", ("verify", "verification", "verified", "प्रमाणित")),
    "password_reset": ("credential", ("password reset", "reset your password")),
    "kyc": ("credential", ("kyc",)),
    "pan": ("credential", ("pan",)),
    "card": ("credential", ("card", "debit card", "credit card")),
    "account": ("credential", ("account", "khata", "खाता")),
    "update": ("urgency", ("update", "अपडेट")),
    "suspended": ("urgency", ("suspended", "suspend", "deactivated", "blocked", "locked", "निलम्बित")),
    "urgent": ("urgency", ("urgent", "immediately", "turunta", "jhattai", "तुरुन्त", "अहिले नै", "within 24 hours", "expire", "expires", "last chance", "act now")),
    "bank": ("financial", ("bank", "banka", "बैंक")),
    "refund": ("financial", ("refund", "फिर्ता")),
    "lottery": ("financial", ("lottery", "chitthi", "चिठ्ठा")),
    "winner": ("financial", ("winner", "won", "jitnu", "jityo", "विजेता")),
    "reward": ("financial", ("reward", "cashback", "bonus", "inam", "इनाम")),
    "prize": ("financial", ("prize", "puraskar", "पुरस्कार")),
    "money": ("financial", ("money", "paisa", "rupaiya", "पैसा", "रुपैयाँ")),
    "crypto": ("financial", ("crypto", "cryptocurrency", "bitcoin", "btc", "ethereum", "usdt")),
    "wallet": ("financial", ("wallet", "esewa", "khalti", "ime pay", "imepay")),
    "payment": ("financial", ("payment", "transfer", "send money", "pathaunus", "pathau", "भुक्तानी")),
    "threat": ("threat", ("police", "legal action", "lawsuit", "arrest", "fine", "penalty", "court", "jail", "प्रहरी", "कारबाही", "will be closed", "will be terminated")),
}
