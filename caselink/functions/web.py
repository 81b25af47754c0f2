"""Fixed values for URL and domain rules."""

#: Official domains of brands.
OFFICIAL_DOMAINS = {
    "esewa": ("esewa.com.np", "esewa.com", "merchant.esewa.com.np"), "khalti": ("khalti.com", "web.khalti.com", "admin.khalti.com"), "imepay": ("imepay.com.np", "ime.com.np"),
    "connectips": ("connectips.com",), "fonepay": ("fonepay.com",), "nabil": ("nabilbank.com",), "nicasia": ("nicasiabank.com",), "globalime": ("globalimebank.com",),
    "machhapuchchhre": ("machbank.com",), "nepalbank": ("nepalbank.com.np",), "rastriyabanijya": ("rbb.com.np",), "nrb": ("nrb.org.np",), "ntc": ("ntc.net.np",),
    "ncell": ("ncell.axiata.com", "ncell.com.np"), "facebook": ("facebook.com", "fb.com", "m.facebook.com"), "instagram": ("instagram.com",), "whatsapp": ("whatsapp.com", "wa.me"),
    "gmail": ("gmail.com", "mail.google.com"), "google": ("google.com", "google.com.np"),
}
#: Brands that are trusted but not taken as impersonated.
NOT_IMPERSONATED = ("gmail", "google")
#: Endings with a high abuse rate, link shorteners, wording.
RISKY_TLDS = ("xyz", "top", "click", "link", "live", "vip", "online", "shop", "site", "icu", "cf", "tk", "ga", "gq", "ml", "buzz", "rest", "fit", "cam", "quest", "work", "surf", "monster", "cyou", "sbs", "lol", "bond")
#: Endings that the threat score takes for risky.
SUSPICIOUS_TLDS = ("xyz", "top", "club", "online", "site", "website", "space", "fun", "icu", "buzz", "cf", "gq", "ml", "ga", "tk", "work", "click", "link", "info", "biz", "pw", "cc", "loan",
                   "racing", "win", "bid", "stream", "download", "review", "accountant", "cricket", "science", "party", "date", "faith", "trade", "men", "gdn", "kim", "wang", "rest", "surf", "bar",
                   "cam", "monster", "hair", "sbs", "cfd", "quest", "boats", "beauty", "makeup", "onl")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "cutt.ly", "is.gd", "rb.gy", "rebrand.ly", "shorturl.at", "ow.ly", "buff.ly", "tiny.cc", "bitly.com")
LURE_WORDS = ("verify", "verification", "kyc", "login", "signin", "secure", "security", "update", "confirm", "unlock", "suspend", "reactivate", "recover", "wallet", "otp", "password", "account", "billing", "refund")
REWARD_WORDS = ("cashback", "reward", "bonus", "prize", "lucky", "winner", "gift", "offer", "claim", "free", "lottery", "draw", "jackpot", "dashain", "tihar")
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("com.np", "org.np", "net.np", "gov.np", "edu.np", "co.uk", "org.uk", "com.au", "co.in", "co.jp", "com.br")
#: Cloud providers and the host suffixes that tell them.
CLOUD_PROVIDERS = {
    "GitHub Pages": ("github.io", "githubusercontent.com"), "Netlify": ("netlify.app", "netlify.com"), "Vercel": ("vercel.app",),
    "Firebase": ("web.app", "firebaseapp.com"), "Backblaze": ("backblazeb2.com",), "Dropbox": ("dropbox.com", "dropboxusercontent.com"),
    "Google Drive": ("drive.google.com", "docs.google.com"), "Cloudflare Pages": ("pages.dev",),
    "Azure Blob": ("blob.core.windows.net", "azurewebsites.net", "azureedge.net"), "Amazon S3": ("s3.amazonaws.com", "amazonaws.com"),
    "DigitalOcean Spaces": ("digitaloceanspaces.com",), "Render": ("onrender.com",), "Railway": ("up.railway.app", "railway.app"),
    "CloudFront": ("cloudfront.net",), "Weebly": ("weebly.com",), "Glitch": ("glitch.me",),
}
#: Words in a cloud-hosted URL that make it suspicious.
CLOUD_LOGIN_WORDS = ("login", "signin", "sign-in", "log-in", "account", "verify", "verification", "secure", "auth", "authenticate", "session", "password",
                     "credential", "unlock", "confirm", "webscr")
CLOUD_MONEY_WORDS = ("bank", "paypal", "wallet", "esewa", "khalti", "imepay", "payment", "billing", "invoice", "refund", "card", "otp", "swift", "transfer")
CLOUD_BRAND_WORDS = ("paypal", "google", "facebook", "microsoft", "apple", "amazon", "netflix", "instagram", "whatsapp", "office365", "outlook", "esewa",
                     "khalti", "imepay", "nabil", "nicasia")
#: Endings and brands that the domain's own risk looks at.
DOMAIN_RISKY_TLDS = ("top", "xyz", "icu", "cyou", "rest", "monster", "click", "link", "gq", "tk", "ml", "cf", "ga", "zip", "mov", "loan", "work", "country", "cam")
PROTECTED_BRANDS = ("paypal", "google", "facebook", "microsoft", "apple", "amazon", "netflix", "instagram", "whatsapp", "esewa", "khalti", "imepay", "nabil",
                    "nicasia", "globalime", "himalayanbank", "nepalbank")
#: Severity and contribution of the rules on a URL; words count 0.15 each, at most 0.55, and are high from four on.
RULES = {
    "is_ip_based": ("high", 0.75), "is_url_shortener": ("medium", 0.50), "is_punycode": ("high", 0.70), "has_homograph_chars": ("critical", 1.0),
    "suspicious_tld": ("high", 0.65), "brand_in_subdomain": ("high", 0.80), "brand_in_domain": ("high", 0.70), "typosquatting": ("critical", 0.95),
    "excessive_subdomains": ("medium", 0.45), "suspicious_keywords": ("medium", 0.15), "suspicious_keyword_single": ("low", 0.20), "long_url": ("low", 0.25),
    "no_https": ("low", 0.20), "double_slash_in_path": ("medium", 0.40), "at_symbol_in_url": ("critical", 0.90), "data_or_js_uri": ("critical", 1.0),
}
