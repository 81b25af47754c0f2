"""Fixed values for brand impersonation: what brands are called, where they are at home, and what imitations look like."""

#: Words that refer to a brand.
BRAND_TOKENS = {
    "microsoft": ("microsoft", "office365", "outlook", "onedrive", "sharepoint", "azure", "xbox", "msn"),
    "google": ("google", "gmail", "youtube", "googleapis"), "apple": ("apple", "appleid", "icloud", "itunes"), "meta": ("meta",),
    "facebook": ("facebook", "fbcdn"), "instagram": ("instagram", "insta"), "whatsapp": ("whatsapp", "wasap", "watsapp"),
    "amazon": ("amazon", "aws", "prime"), "paypal": ("paypal",), "netflix": ("netflix",), "telegram": ("telegram",), "discord": ("discord",),
    "github": ("github",), "dropbox": ("dropbox",), "adobe": ("adobe", "acrobat", "photoshop"), "linkedin": ("linkedin",),
    "x_twitter": ("twitter", "tweet"), "cloudflare": ("cloudflare",), "openai": ("openai", "chatgpt"), "esewa": ("esewa",),
    "khalti": ("khalti",), "imepay": ("imepay", "ime-pay"), "connectips": ("connectips",), "fonepay": ("fonepay",),
    "nagarik_app": ("nagarik", "nagarikapp"), "government_of_nepal": ("nepalgov", "nepal-government"), "nabil_bank": ("nabil", "nabilbank"),
    "nic_asia": ("nicasia", "nic-asia"), "global_ime": ("globalime", "global-ime"), "himalayan_bank": ("himalayanbank", "himalayan-bank"),
    "nepal_investment_mega": ("nimb", "nibl"), "everest_bank": ("everestbank",), "kumari_bank": ("kumaribank",),
    "siddhartha_bank": ("siddharthabank",), "sanima_bank": ("sanimabank",), "machhapuchchhre_bank": ("machbank", "machhapuchchhre"),
    "laxmi_sunrise": ("laxmisunrise", "laxmibank"), "citizens_bank": ("ctznbank", "citizensbank"), "prabhu_bank": ("prabhubank",),
    "rastriya_banijya": ("rastriyabanijya", "rbbank"), "nepal_bank": ("nepalbank",), "adbl": ("adbl",), "nmb_bank": ("nmbbank",),
    "prime_bank": ("primebank",), "standard_chartered_nepal": ("standardchartered",),
}
#: Registered domains of brands, and endings below which every domain is one's own.
BRAND_DOMAINS = {
    "microsoft": ("microsoft.com", "office.com", "office365.com", "outlook.com", "live.com", "windows.com", "xbox.com", "azure.com", "microsoftonline.com",
                  "sharepoint.com", "onedrive.com", "msn.com", "bing.com", "skype.com", "microsoft365.com"),
    "google": ("google.com", "gmail.com", "youtube.com", "android.com", "googleapis.com", "googleusercontent.com", "gstatic.com", "goo.gl", "google.co.uk",
               "google.de", "google.com.np", "withgoogle.com", "blogger.com", "blogspot.com", "youtu.be"),
    "apple": ("apple.com", "icloud.com", "itunes.com", "me.com", "mac.com"), "meta": ("meta.com", "metamail.com", "fb.me"),
    "facebook": ("facebook.com", "fb.com", "fbcdn.net", "messenger.com"), "instagram": ("instagram.com", "cdninstagram.com", "ig.me"),
    "whatsapp": ("whatsapp.com", "whatsapp.net", "wa.me"),
    "amazon": ("amazon.com", "amazon.co.uk", "amazon.ca", "amazon.de", "amazon.co.jp", "amazon.in", "amazonaws.com", "media-amazon.com", "primevideo.com", "a2z.com"),
    "paypal": ("paypal.com", "paypal.me", "paypalobjects.com"), "netflix": ("netflix.com", "nflxvideo.net", "nflximg.net"),
    "telegram": ("telegram.org", "telegram.me", "t.me", "telesco.pe"), "discord": ("discord.com", "discord.gg", "discordapp.com", "discord.media"),
    "github": ("github.com", "github.io", "githubusercontent.com", "githubassets.com"), "dropbox": ("dropbox.com", "dropboxusercontent.com", "db.tt"),
    "adobe": ("adobe.com", "adobelogin.com", "acrobat.com", "typekit.net"), "linkedin": ("linkedin.com", "lnkd.in", "licdn.com"),
    "x_twitter": ("x.com", "twitter.com", "t.co", "twimg.com"),
    "cloudflare": ("cloudflare.com", "cloudflare.net", "cloudflareinsights.com", "pages.dev", "workers.dev"),
    "openai": ("openai.com", "chatgpt.com", "oaiusercontent.com", "oaistatic.com"), "esewa": ("esewa.com.np",), "khalti": ("khalti.com",),
    "imepay": ("imepay.com.np", "imeremit.com.np"), "connectips": ("connectips.com",), "fonepay": ("fonepay.com",), "nagarik_app": ("nagarikapp.gov.np",),
    "government_of_nepal": ("nepal.gov.np", "moha.gov.np", "mof.gov.np", "ird.gov.np", "dotm.gov.np"), "nabil_bank": ("nabilbank.com",),
    "nic_asia": ("nicasiabank.com",), "global_ime": ("globalimebank.com",), "himalayan_bank": ("himalayanbank.com",),
    "nepal_investment_mega": ("nimb.com.np",), "everest_bank": ("everestbankltd.com",), "kumari_bank": ("kumaribank.com",),
    "siddhartha_bank": ("siddharthabank.com",), "sanima_bank": ("sanimabank.com",), "machhapuchchhre_bank": ("machbank.com",),
    "laxmi_sunrise": ("laxmisunrise.com",), "citizens_bank": ("ctznbank.com",), "prabhu_bank": ("prabhubank.com",), "rastriya_banijya": ("rbb.com.np",),
    "nepal_bank": ("nepalbank.com.np",), "adbl": ("adbl.gov.np",), "nmb_bank": ("nmb.com.np", "nmbbanknepal.com"), "prime_bank": ("primebank.com.np",),
    "standard_chartered_nepal": ("sc.com",),
}
BRAND_ENDINGS = {"gov.np": "government_of_nepal", "mil.np": "government_of_nepal"}
#: Words put before or after a brand's name, and words that ask for credentials.
AFFIXES = ("secure", "login", "signin", "log-in", "sign-in", "verify", "verification", "support", "help", "helpdesk", "auth", "authentication", "security",
           "account", "accounts", "update", "confirm", "unlock", "recovery", "reset", "service", "services", "center", "centre", "portal", "online",
           "official", "id", "wallet", "pay", "payment", "billing", "bank", "banking", "alert", "team", "mail", "webmail", "edge", "origin", "cdn", "app")
CREDENTIAL_WORDS = ("login", "signin", "sign-in", "log-in", "password", "passwd", "credential", "verify", "verification", "auth", "authenticate", "session",
                    "account", "secure", "otp", "webscr", "wallet", "billing", "card", "cvv", "pin")
#: What each finding adds to the score, and levels.
BRAND_WEIGHTS = {"official_domain_mismatch": 0.30, "brand_token": 0.10, "typosquatting": 0.30, "homoglyph": 0.30, "misleading_affix": 0.15,
                 "cloud_hosted_impersonation": 0.15, "brand_conflict": 0.35, "young_domain": 0.10, "no_ssl": 0.05, "whois_hidden": 0.05, "suspicious_keywords": 0.10}
BRAND_LEVELS = {"high": 0.60, "medium": 0.30}
#: Pairs and single characters that are read as letters.
READ_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m"))
READ_SINGLE = ("013457", "oleast", "89@$!", "bgasi")
#: Characters of other scripts that look like Latin letters.
LOOK_ALIKES = {
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ґ": "r", "ӏ": "l", "м": "m", "н": "h", "т": "t", "в": "b", "к": "k",
    "ԁ": "d", "ɡ": "g", "һ": "h", "ј": "j", "Ӏ": "l", "ҽ": "s", "ԛ": "q", "յ": "h",
}
