"""Character maps, word lists and patterns that results depend on."""

# Digits and letters that are mapped.
DIGITS_FROM = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
DIGITS_TO = "01234567890123456789"
LETTERS_FROM = "يكأإؤةٱ"
LETTERS_TO = "یکااوها"
CONTROL_CHARS = r"[‌‍‎‏‪-‮﻿­⁠᠎]"
PERSIAN_PUNCT = '[،؛؟!٪«»"]+'

# Words written together and their parts.
DEGLUE = {
    "درحال": "در حال",
    "باسلام": "با سلام",
    "خداروشکر": "خدا رو شکر",
    "فوقالعاده": "فوق العاده",
    "اززحماتشون": "از زحماتشون",
    "ازبچگی": "از بچگی",
    "مداومبه": "مداوم به",
    "هردکتری": "هر دکتری",
    "اماایشان": "اما ایشان",
    "وسپس": "و سپس",
    "برطرفشد": "برطرف شد",
}

# Negations that stopword removal keeps.
NEGATION_KEEP = ["نه", "نخیر", "نیست", "نمی", "نمي", "نبود", "نشد", "بدون"]

# Stopwords of the medical variant, its bigrams, and what is never removed.
MEDICAL_STOPWORDS = [
    "عالی", "خوب", "بهترین", "فوقالعاده", "محشر", "بینظیر", "راضی", "رضایت", "ناراضی",
    "مرسی", "ممنون", "تشکر", "سپاس", "قدردانی",
    "دکتر", "پزشک", "خانم", "آقا", "آقای", "جناب", "ایشون", "ایشان",
    "مطب", "منشی", "پرسنل", "پذیرش", "نوبت", "نوبتدهی", "وقت", "معطلی", "شلوغ", "شلوغی", "هزینه", "ویزیت", "پرداخت", "کارت", "بیمه", "تومان", "تومن", "خدمات", "برخورد", "پاسخگو",
    "حوصله", "اخلاق", "حاذق", "مودب", "محترم", "مهربان", "دلسوز", "صبور", "دقیق", "خوشبرخورد",
    "سلام", "درود", "واقعا", "فعلا", "مراجعه", "نتیجه", "هستم", "هستن", "هستند", "داشتم", "بودم", "بودن",
]
MEDICAL_BIGRAMS = [("فوق", "العاده"), ("بی", "نظیر")]
LATIN_ALLOWLIST = ["acl", "mcl", "pcl", "mri", "ct", "prp", "hpv", "pcnl", "rirs", "tul", "ivf", "iui", "psa", "ms", "avm", "co2", "l5", "s1", "t12"]
HIGH_RISK_LIBRARY = ["درد", "دارو", "درمان", "تشخیص", "عمل", "جراحی", "بی", "فوق"]
HIGH_RISK_FINALIZE = ["درد", "دارو", "درمان", "تشخیص", "عمل", "جراحی", "کار"]

PLACEHOLDER = "عدم رضایت"

# Fixed values: (name, pattern, weight) of the labeling pool's scores.
POOL_NEGATIVE = [
    ("strong_negative", r"(افتضاح|مزخرف|فاجعه|بدترین|خیلی\s*بد|به\s*درد\s*نخورد|به\s*درد\s*نمیخوره|به\s*درد\s*نمی\s*خوره)", 2.6),
    ("not_recommend", r"(پیشنهاد\s*نمی\s*کنم|توصیه\s*نمی\s*کنم|دیگه\s*نمیرم|دیگر\s*نمیرم|پشیمون\s*شدم|پشیمان\s*شدم)", 2.6),
    ("rude_behavior", r"(بد\s*برخورد|بی\s*ادب|بی\s*احترام|توهین|تحقیر|داد\s*زد|اخمو|بی\s*حوصله)", 2.2),
    ("long_wait", r"(معطلی|منتظر|تاخیر|تأخیر|دیر\s*کرد|ساعت\s*ها|نوبت.*عقب|شلوغ)", 1.8),
    ("no_response", r"(پاسخگو\s*نبود|جواب\s*نمی\s*ده|تلفن.*جواب|منشی.*جواب|کسی\s*پاسخگو)", 1.9),
    ("money", r"(هزینه|گران|گرون|پولکی|پول\s*اضافی|ویزیت.*بالا|بیخود\s*پول)", 1.4),
    ("misdiagnosis", r"(تشخیص.*اشتباه|اشتباه\s*تشخیص|غلط\s*تشخیص|دارو.*اشتباه)", 2.2),
    ("no_improve", r"(بهتر\s*نشد|بدتر\s*شدم|اثر\s*نداشت|فایده\s*نداشت|نتیجه\s*نگرفتم|درمان\s*نشد|هیچ\s*تغییری)", 2.0),
    ("careless", r"(سرسری|بی\s*دقت|بدون\s*معاینه|توجه\s*نکرد|گوش\s*نکرد|بی\s*تفاوت)", 1.6),
    ("disappointed_soft", r"(متاسفانه|متأسفانه|کاش|ناراضی|راضی\s*نبودم|اصلا\s*خوب\s*نبود|اصلاً\s*خوب\s*نبود)", 1.6),
]
POOL_POSITIVE = [
    ("strong_positive", r"(عالی|فوق\s*العاده|بی\s*نظیر|محشر|بهترین)", 2.5),
    ("thanks", r"(ممنون|سپاس|تشکر|مرسی|خدا\s*خیر|دستتون\s*درد\s*نکنه|دستش\s*درد\s*نکنه)", 1.3),
    ("skilled", r"(حاذق|ماهر|کاربلد|متخصص|تشخیص\s*دقیق|تجربه\s*بالا)", 1.6),
    ("kind", r"(مهربان|خوش\s*برخورد|با\s*حوصله|صبور|آرام)", 1.0),
    ("improved", r"(بهتر\s*شدم|خوب\s*شدم|درمان\s*شدم|نتیجه\s*گرفتم)", 1.8),
]
POOL_SERVICE = r"(نوبت|نوبت\s*دهی|منشی|مطب|تلفن|تماس|ویزیت|هزینه|معطلی|انتظار|صف|ساعت|شلوغ)"
POOL_MILD_NEGATIVE = r"(بد|ضعیف|اشتباه|ناراضی|راضی\s*نبود|متاسفانه|متأسفانه|پشیمون|پشیمان|بی\s*نظم|بی\s*مسئولیت|بی\s*توجه|سرسری)"

# Fixed values: (name, pattern, weight) of the weak labels' scores, and their cues.
WEAK_NEGATIVE = [
    ("strong_negative", r"(افتضاح|مزخرف|فاجعه|بدترین|اصلا\s*خوب\s*نیست|اصلاً\s*خوب\s*نیست)", 3.0),
    ("not_recommend", r"(پیشنهاد\s*نمی\s*کنم|توصیه\s*نمی\s*کنم|دیگه\s*نمیرم|دیگر\s*نمیرم|پشیمون|پشیمان)", 2.6),
    ("rude_behavior", r"(بد\s*برخورد|بی\s*ادب|بی\s*احترام|توهین|تحقیر|داد\s*زد|بی\s*حوصله)", 2.4),
    ("misdiagnosis", r"(تشخیص.*اشتباه|اشتباه\s*تشخیص|غلط\s*تشخیص|دارو.*اشتباه)", 2.4),
    ("no_improve_hard", r"(اثر\s*نداشت|فایده\s*نداشت|بدتر\s*شدم|درمان\s*نشد)", 2.0),
    ("no_response", r"(پاسخگو\s*نبود|جواب\s*نمی\s*ده|تلفن.*جواب|منشی.*جواب)", 2.0),
    ("long_wait", r"(معطلی|معطل|تاخیر|تأخیر|ساعت\s*ها|چهار\s*ساعت|پنج\s*ساعت|صف|شلوغ)", 1.6),
    (
        "money",
        r"(هزینه\s*تراش\w*|پولکی|ویزیت.*بالا|"
        r"خیلی\s*گرون|خیلی\s*گران|بسیار\s*گرون|بسیار\s*گران|فوق\s*العاده\s*گرون|فوق\s*العاده\s*گران|"
        r"گرون\s*بود|گران\s*بود|گرون\s*حساب|گران\s*حساب|"
        r"گرانقیمت|گران\s*قیمت|قیمت.*بالا|هزینه.*بالا)",
        1.8,
    ),
    ("not_satisfied", r"(راضی\s*نبودم|اصلا\s*راضی\s*نیستم|اصلاً\s*راضی\s*نیستم)", 2.6),
    ("pharmacy_profit", r"(داروخانه|مکمل|کلاژن|قرص.*گران|به\s*نفع\s*داروخانه|مکمل.*زیاد)", 1.9),
    ("disappointed_soft", r"(متاسفانه|متأسفانه|ناراضی)", 1.2),
]
WEAK_POSITIVE = [
    ("strong_positive", r"(عالی|فوق\s*العاده|بی\s*نظیر|محشر|بهترین)", 2.5),
    ("improved", r"(بهتر\s*شدم|خوب\s*شدم|درمان\s*شدم|نتیجه\s*گرفتم)", 1.8),
    ("skilled", r"(حاذق|ماهر|کاربلد|تشخیص\s*دقیق|تجربه\s*بالا)", 1.4),
    ("kind", r"(مهربان|خوش\s*برخورد|خوش‌برخورد|با\s*حوصله|صبور|آرام|خوش\s*اخلاق|خوش‌اخلاق|محترم|مودب)", 1.2),
    ("thanks", r"(ممنون|سپاس|تشکر|مرسی|خدا\s*خیر|دستتون\s*درد\s*نکنه|دستش\s*درد\s*نکنه)", 1.0),
    ("good_doctor", r"(دکتر|پزشک)\s*خ[و]{1,3}ب", 1.6),
    ("good_word", r"\bخ[و]{1,3}ب\b", 0.9),
]
WEAK_CUES = {
    "service": r"(نوبت|نوبت\s*دهی|منشی|مطب|تلفن|تماس|ویزیت|هزینه|معطلی|انتظار|صف|شلوغ|لغو|نقدی)",
    "service_strong": r"(افتضاح|بی\s*نظم|بی\s*نظمی|بد\s*برخورد|پاسخگو\s*نبود|جواب\s*نمی\s*ده|ساعت\s*ها|خیلی\s*معطل|خیلی\s*شلوغ|گرون|گران|پولکی|نقدی|بین\s*مریض\s*حساب)",
    "info": r"(ام\s*ار\s*ای|mri|آزمایش|سونو|سونوگرافی|نمونه\s*برداری|عمل|جراحی|نوار|بیوپسی|جواب\s*آزمایش)",
    "early": r"(منتظر\s*جواب\s*آزمایش|منتظر\s*جواب\s*ازمایش|منتظر\s*نتیجه|فعلا\s*منتظر|فعلاً\s*منتظر|در\s*حال\s*پیگیری|تازه\s*شروع\s*کردم|هنوز\s*زوده\s*نظر\s*بدم)",
    "self_harm": r"(خودکشی|خود\s*کشی)",
    "improved": r"(الان|حالا).*(بهترم|بهتر\s*شدم|خیلی\s*بهتر)",
    "complaint": r"(منشی|نوبت|مطب|ویزیت|هزینه|پولکی|معطلی|بد\s*برخورد|تشخیص.*اشتباه|دارو.*اشتباه|داروخانه|مکمل)",
}

# What a label may be written as.
LABEL_WORDS = {-1: ["-1", "neg", "negative", "منفی"], 0: ["0", "neu", "neutral", "خنثی", "mixed"], 1: ["1", "pos", "positive", "مثبت"]}

# Patterns of the quality audit.
AUDIT_PATTERNS = {
    "url": r"(?i)(https?://\S+|www\.\S+)",
    "email": r"(?i)\b[\w\.-]+@[\w\.-]+\.\w+\b",
    "phone": r"(\+?98|0)?\s*9\d{9}\b",
    "latin": r"[A-Za-z]",
    "digit": r"\d",
    "non_standard": r"[^؀-ۿ0-9A-Za-z\s]",
}

# What the first step's report counts.
STEP_PATTERNS = {
    "control": CONTROL_CHARS,
    "non_standard": r"[^0-9A-Za-z؀-ۿ\s]",
    "elongation": r"(\S)\1{2,}",
    "latin": r"[A-Za-z]",
    "digit": r"\d",
    "arabic_variants": r"[يكأإؤةٱئ]",
}
