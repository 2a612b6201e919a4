"""Word lists and patterns that the rules are defined by."""

# Heading, caption and jump-line rules.
TERMINAL = ".!?;।॥"
CAPTION_PREFIXES = ["photo", "image", "caption", "source", "credit", "courtesy", "file"]
CAPTION_PREFIXES_DEVANAGARI = ["फोटो", "फ़ोटो", "चित्र", "तस्वीर", "सौजन्य", "फाइल फोटो"]
AGENCIES = ["ani", "pti", "ap", "reuters", "afp", "getty", "ians"]
AGENCIES_DEVANAGARI = ["पीटीआई", "एएनआई", "रॉयटर्स", "एएफपी", "आईएएनएस"]
JUMP_PATTERNS = [r"continued\s+on\s+page", r"continued\s+from\s+page", r"see\s+page", r"turn\s+to\s+page", r"read\s+more", r"jump\s+to\s+page", r"continued", r"see\s+story"]
JUMP_PATTERNS_DEVANAGARI = [r"पृष्ठ\s*\d*\s*पर\s*जारी", r"जारी\s*पृष्ठ", r"शेष\s*पृष्ठ", r"शेष\s*समाचार", r"देखें\s*पृष्ठ", r"आगे\s*पढ़ें", r"विस्तार\s*से\s*पृष्ठ", r"जारी"]
JUMP_PAGE = r"page\s+\d+"
JUMP_PAGE_DEVANAGARI = r"पृष्ठ\s*\d+|पेज\s*\d+"

# Jump targets in article texts.
TARGET_PHRASE = r"(?:more\s+on|continued\s+on|continued\s+from|report\s+on|full\s+report\s+on|turn\s+to|see|to\s+be\s+continued)[^\n]{0,100}?(?:page|pg\.?|p\.?)\s*[-:]?\s*(\d{1,4})\b"
TARGET_PAGE = r"(?:page|pg\.?|p\.?)\s*[-:]?\s*(\d{1,4})\b"
TARGET_MARKER = r"[^\n]{0,60}(?:page|pg\.?|p\.?)\s*[-:]?\s*\d{1,4}\b"
JUMP_SLUG = r"[►▸>»]\s*(.+?)\s*,?\s*(?:page|pg\.?|p\.?)\s*[-:]?\s*\d{1,4}\b"
TITLELESS = ["untitled", "untitled article", "continued", "more on page", "report on page", "continued from page"]
GENERIC_HEADLINES = ["windows", "photo", "photograph", "picture", "file photo", "pti photo", "more on page", "report on page", "continued"]

# Stop words of matching and of keywords.
STOP_WORDS = (
    "the a an and or but of to in on for from with by at as is are was were be been being that this these those it its into over after before than "
    "then they their them he she his her we our you your i me my will would could should has have had not no also said says report reports page continued "
    "more see full"
).split()

# Entities.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ORGANISATIONS = ["Ltd", "Limited", "Bank", "University", "Corporation", "Ministry", "Government", "Company", "Inc"]

# Bylines, datelines, advertisements.
BYLINE = r"^\s*by\s+([A-Z][A-Za-z.\-' ]{2,60})"
BYLINE_ROLE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\s*\n?\s*(?:Correspondent|Reporter|Bureau|Staff Writer|Special Correspondent)"
BYLINE_EMAIL = r"\b([A-Za-z]+\.[A-Za-z]+)\s*@\s*([A-Za-z0-9.\-]+\.[a-z]{2,})\b"
DATELINE = r"^\s*([A-Za-z][A-Za-z .]{2,30}?)(?:,\s*([A-Za-z]+\.?\s+\d{1,2}(?:,?\s*\d{4})?))?\s*[:—\-]\s*"
ADVERTISEMENT = [r"(?i)\bwww\.[a-z0-9\-]+\.[a-z]{2,}\b", r"(?i)\bcall\s+now\b", r"(?i)\b(?:rs\.?|inr)\s?\d[\d,]*\s*(?:only|/-)\b", r"(?i)\bfor\s+booking\b", r"\b\d{10}\b"]
GAZETTEER = [
    "NEW DELHI", "MUMBAI", "CHANDIGARH", "BENGALURU", "BANGALORE", "CHENNAI", "KOLKATA", "HYDERABAD", "PUNE", "AHMEDABAD", "JAIPUR", "LUCKNOW", "PATNA",
    "BHOPAL", "AMRITSAR", "LUDHIANA", "SHIMLA", "DEHRADUN", "GURUGRAM", "GURGAON", "NOIDA", "SRINAGAR", "JAMMU", "RAIPUR", "RANCHI", "GUWAHATI",
    "THIRUVANANTHAPURAM", "KOCHI", "NAGPUR", "INDORE", "SURAT", "AGRA", "VARANASI", "KANPUR", "LONDON", "WASHINGTON", "NEW YORK", "GENEVA", "BEIJING",
    "ISLAMABAD", "KATHMANDU", "DHAKA", "COLOMBO",
]

# Sentiment.
POSITIVE = (
    "win wins won winning victory success successful growth grows improve improved improvement praise praised boost boosted record achievement celebrate "
    "celebration welcome welcomed progress gain gains positive hope hopeful benefit benefits recovery award awarded honour honored honoured surge rally "
    "breakthrough historic milestone"
).split()
NEGATIVE = (
    "death dead died killed kill murder attack attacked crash accident disaster crisis protest protests arrest arrested fraud scam corruption violence "
    "violent riot riots flood floods fire collapse collapsed loss losses decline declined fail failed failure concern concerns warning warned threat threatened "
    "controversy scandal injured injury clash clashes outbreak shortage"
).split()

# Page furniture.
MASTHEADS = ["THE ASIAN AGE", "THE HINDU", "TIMES OF INDIA", "INDIAN EXPRESS", "HINDUSTAN TIMES", "THE TELEGRAPH", "DECCAN CHRONICLE", "SIASAT", "INQUILAB"]
MASTHEADS_OTHER = ["दैनिक भास्कर", "दैनिक जागरण", "अमर उजाला", "नवभारत टाइम्स", "हिंदुस्तान", "हिन्दुस्तान", "राजस्थान पत्रिका", "पंजाब केसरी", "जनसत्ता", "नई दुनिया", "पत्रिका", "سیاست", "انقلاب"]
PRINTERS_MARKS = ["CMYK", "CMY", "MYK", "C MY K", "C MV K"]
HEADER_WORDS = "MONDAY TUESDAY WEDNESDAY THURSDAY FRIDAY SATURDAY SUNDAY WWW PRICE VOL VOLUME ISSUE JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
HEADER_WORDS_OTHER = (
    "सोमवार मंगलवार बुधवार गुरुवार शुक्रवार शनिवार रविवार मूल्य कीमत पृष्ठ अंक वर्ष संस्करण जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर सितम्बर अक्टूबर नवंबर "
    "नवम्बर दिसंबर दिसम्बर چہارشنبہ پنجشنبہ جمعہ ہفتہ اتوار پیر منگل بدھ جمعرات قیمت جلد شمارہ صفحہ جنوری فروری مارچ اپریل مئی جون جولائی اگست ستمبر اکتوبر نومبر دسمبر"
).split()
HEADER_PATTERNS = [r"\bVOL\.?\s*\d+", r"\bVOLUME\s*\d+", r"\bISSUE\s*\d+", r"\bPRICE\s*[:₹]?\s*\d+", r"\bWWW\.", r"\bPAGE\s+\d+\b", r"\bEDITION\b"]
HEADER_PATTERNS_OTHER = [r"मूल्य\s*[:₹]?\s*\d+", r"कीमत\s*[:₹]?\s*\d+", r"पृष्ठ\s+\d+", r"अंक\s*\d+", r"वर्ष\s*\d+", r"قیمت\s*[:₹]?\s*\d+", r"جلد\s*\d+", r"شمارہ\s*\d+", r"صفحہ\s+\d+"]
HEADER_DAY = (
    r"^\s*(MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY|JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUN(?:E)?|JUL(?:Y)?|AUG(?:UST)?|"
    r"SEP(?:TEMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)(\s+\d{1,2})?(\s*,?\s+\d{4})?\s*$"
)
HEADER_DAY_OTHER = (
    r"^\s*(सोमवार|मंगलवार|बुधवार|गुरुवार|शुक्रवार|शनिवार|रविवार|जनवरी|फरवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितंबर|सितम्बर|अक्टूबर|नवंबर|नवम्बर|दिसंबर|दिसम्बर|"
    r"چہارشنبہ|پنجشنبہ|جمعہ|ہفتہ|اتوار|پیر|منگل|بدھ|جمعرات|جنوری|فروری|مارچ|اپریل|مئی|جون|جولائی|اگست|ستمبر|اکتوبر|نومبر|دسمبر)(\s+\d{1,2})?(\s*,?\s+\d{4})?\s*$"
)
ARTICLE_SIGNS = [":", ";", "?", "!", "'", '"', " CM ", " PM ", " CONGRESS ", " POLICE ", " COURT ", " GOVERNMENT ", " MINISTER ", " LEADER ", " SAYS ", " SAID ", " LOCKDOWN ", " CUSTODY ", " PUBLISHERS ", " SRINAGAR "]
SECTION_HEADER = [r"^[A-Z ]+\s+\d+$", r"^[ऀ-ॿ ]+\s*\d+$"]
CAPTION_LINES = [r"^PHOTO\s*:", r"^FILE\s*PHOTO", r"^FILE\s*:", r"^PHOTO\s+BY", r"^COURTESY\s+", r"^PIC\s*:", r"^IMAGE\s*:"]
CAPTION_LINES_DEVANAGARI = [r"^फोटो\s*:", r"^फ़ोटो\s*:", r"^फाइल\s*फोटो", r"^तस्वीर\s*:", r"^चित्र\s*:", r"^सौजन्य\s*:", r"^तस्वीर\s*सौजन्य"]

# Classes of layout blocks.
IMAGES = ["figure", "image", "photo", "picture"]
TEXTUAL = ["plain text", "title", "figure_caption"]
