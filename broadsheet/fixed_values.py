"""Word lists, patterns, thresholds and labels that results depend on.

Nothing here is logic. Every entry must stay as written for results to match.
Regular expressions are Java syntax.
"""

# --- categories --------------------------------------------------------------
INDUSTRY, CAPITAL, POLICY, ACADEMIC = "行业", "资本", "政策", "学术"
CATEGORIES = [INDUSTRY, CAPITAL, POLICY, ACADEMIC]
UNDATED_CATEGORIES = [INDUSTRY, CAPITAL]
CATEGORY_ORDER = {POLICY: 0, INDUSTRY: 1, CAPITAL: 2, ACADEMIC: 3}

# --- urls ----------------------------------------------------------------------
TRACKING_PARAMETERS = ["fbclid", "gclid", "spm"]
TRACKING_PREFIX = "utm_"
DICTIONARY_DOMAINS = [
    "merriam-webster.com", "merriam-webstercollegiate.com", "m-w.com",
    "englishreference.com", "vocabulary.com", "definder.net",
    "collinsdictionary.com", "oed.com", "wordnet-online.com",
    "yourdictionary.com", "dictionary.com", "wordreference.com",
    "quword.com", "wordsdefined.com", "dictai.org", "eudic.net",
    "qimingbaike.com", "name-doctor.com", "behindthename.com",
]
TWO_LABEL_SUFFIXES = ["com.cn", "co.uk", "com.hk"]
SHARED_ACCOUNT_HOST = "mp.weixin.qq.com"
PAPER_HOSTS = ["arxiv.org", "www.arxiv.org"]
NEWS_WRAPPER_HOSTS = ["www.bing.com", "bing.com"]
NON_OFFICIAL_HOSTS = [
    "ithome.com", "36kr.com", "stcn.com", "pedaily.cn", "bciwiki.com",
    "theverge.com", "techcrunch.com", "amazon.com", "taobao.com",
    "tmall.com", "jd.com", "youtube.com", "weibo.com", "zhihu.com",
]
NON_PRODUCT_PATH = (
    r"(?i)/(?:news|newsroom|blog|press|article|review|support|faq|about|career|download)(?:/|$)"
)

# --- dates ---------------------------------------------------------------------
# Search topics whose one-group rules are narrowed by the topic's intent, and what a policy query ends with.
NARROWED_TOPICS = ["企业", "眼镜可穿戴"]
POLICY_QUERY_SUFFIX = " 中国"
BEIJING = "Asia/Shanghai"
NUMERIC_DATE = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
MONTH_FIRST_DATE = r"\b[A-Za-z]{3,9} \d{1,2}, \d{4}\b"
DAY_FIRST_DATE = r"\b\d{1,2} [A-Za-z]{3,9} \d{4}\b"
DATE_HINT = r"20\d{2}[-/年]\d{1,2}[-/月]\d{1,2}|(?<!\d)\d{1,2}[-/月]\d{1,2}(?:日|\b)"
ORDINAL_ORIGIN = "0001-01-01"

# --- scores --------------------------------------------------------------------
FRESHNESS_TIERS = [(1, 1.0), (3, 0.8), (7, 0.45), (14, 0.2), (30, 0.05)]
FRESHNESS_LIMIT_DAYS = 30
KIND_RATINGS = {"original": (85, 60), "media": (80, 70), "secondary": (60, 50), "unknown": (0, 0)}
SOURCE_KINDS = ["original", "media", "secondary", "unknown"]
AUTHORITY_WEIGHT, RECOGNITION_WEIGHT = 0.7, 0.3
GOV_RATING, PAPER_RATING = (100, 85), (70, 85)
DEFAULT_CATEGORY_WEIGHTS = {INDUSTRY: 1.2, CAPITAL: 1.2, POLICY: 1.2, ACADEMIC: 1.0}
EEG_WITHOUT_EMOTION_FACTOR = 0.95
EEG_WORDS = r"(?i)脑电|\bEEG\b|electroencephal"
EMOTION_WORDS = r"(?i)情绪识别|情感识别|情感计算|emotion recognition|affective computing|emotion decoding"
ACCEPT_THRESHOLD = 60
DOMAIN_RATINGS = {
    "nmpa.gov.cn": (100, 95), "gov.cn": (100, 95), "nature.com": (95, 95),
    "science.org": (95, 95), "arxiv.org": (70, 85), "stdaily.com": (90, 85),
    "xinhuanet.com": (95, 95), "news.cn": (95, 95), "people.com.cn": (95, 95),
    "stcn.com": (85, 85), "36kr.com": (80, 85), "ithome.com": (80, 80),
    "pedaily.cn": (80, 75), "junhe.com": (85, 60), "bciwiki.com": (70, 50),
}
RATING_BASIS = {
    "configured": "已配置的独立域名", "government": "政府机构域名", "campus": "高校或科研机构域名",
    "account": "公众号身份未独立核实", "platform": "媒体平台账号未独立核实",
    "reprint": "转载或分发平台", "new": "新域名待核实", "none": "无有效发布者",
}
NATIONAL_POLICY_HOSTS = [
    "www.gov.cn", "gov.cn", "nmpa.gov.cn", "miit.gov.cn", "moe.gov.cn", "most.gov.cn",
    "nhc.gov.cn", "samr.gov.cn", "cac.gov.cn", "ndrc.gov.cn", "npc.gov.cn", "stats.gov.cn",
    "mof.gov.cn", "mohrss.gov.cn", "cnipa.gov.cn", "sac.gov.cn",
]
LOCAL_POLICY_MEDIA = [
    "bjd.com.cn", "bjnews.com.cn", "xinmin.cn", "cnr.cn", "people.com.cn", "xinhuanet.com",
    "news.cn", "cctv.com", "stdaily.com", "southcn.com", "sznews.com", "sztv.com.cn",
]

# --- interests -----------------------------------------------------------------
INTEREST_ALIASES = {
    "agent": ["agents", "ai agent", "ai agents", "智能体"],
    "llm": ["llms", "large language model", "large language models", "大语言模型", "大模型"],
    "mcp": ["model context protocol", "模型上下文协议"],
    "ai": ["artificial intelligence", "人工智能"],
}
SKIP, WATCH, EXPLORE = "略过", "关注", "深挖"
RECOMMENDATION_ENGLISH = {EXPLORE: "Explore", WATCH: "Watch", SKIP: "Skip"}

# --- business gate ---------------------------------------------------------------
CORE_SIGNAL = (
    r"(?i)脑机|脑电|神经数据|神经接口|耳周|耳部电极|干电极|生物电|神经反馈|\b(?:eeg|bci|ecog)\b"
    r"|electroencephal|brain.computer|brain.machine|neural (?:data|signal|interface)|ear.eeg"
    r"|neurofeedback|dry electrode"
)
AUDIO_SIGNAL = r"(?i)耳机|headphones?|headsets?|earbuds?"
GLASSES_SIGNAL = r"(?i)AI\s*眼镜|智能眼镜|脑电眼镜|眼电眼镜|\b(?:AI|smart|EEG|EOG)\s+glasses\b"
WEARABLE_SIGNAL = r"(?i)AI可穿戴|智能可穿戴|\bAI\s+wearables?\b"
BIOSIGNAL = r"(?i)脑电|神经反馈|生理信号|生物电|认知|睡眠|情绪|\b(?:EEG|EOG|biosignal|neurofeedback)\b"
APPLICATION_SIGNAL = (
    r"(?i)教育|课堂|教学|听觉训练|学习|睡眠|情绪|新品|发布|降噪|眼动|眼控|交互|视障|无障碍|education|classroom"
    r"|learning|sleep|emotion|launch|release|noise.cancel|eye.tracking|interaction"
)
TARGET_APPLICATION_SIGNAL = (
    r"(?i)教育|课堂|教学|听觉训练|学习|专注|注意力|睡眠|情绪|情感|认知|眼动|眼控|视障|无障碍|education|classroom"
    r"|learning|attention|sleep|emotion|affective|cognitive|eye.tracking|accessib"
)
EVENT_SIGNAL = (
    r"(?i)发布|新品|研发|融资|收购|并购|任命|聘|更新|研究|产品|平台|数据|设备|传感|launch|release|funding|rais"
    r"|appoint|sdk|studio|update|data|sensor|research|product"
)
EXPLORE_FORM = r"(?i)可穿戴|wearable"
EXPLORE_USE = r"(?i)生物传感|柔性|睡眠|情绪|生理|biosens|flexible|sleep|emotion|physiolog"
POLICY_TITLE = r"(发布|印发|公布|征求意见).{0,30}(条例|规定|办法|标准|指南)|监管政策|国家标准"
CAPITAL_TITLE = r"(?i)融资|并购|收购|天使轮|种子轮|[ABCDEF]轮|funding|raises|acquisition"
RESEARCH_TITLE = r"(?i)论文|研究团队|研究者|实验组|试验|准确率|解码|模型|dataset|decoding|accuracy|paper|study"
RELEASE_TITLE = r"(?i)融资|新品|SDK|产品发布|版本更新|release|launch|studio"
NATIONAL_EVIDENCE = (
    r"中国|我国|国务院|全国人大|国家(?:药监局|市场监管总局|卫生健康委|卫健委|发改委|网信办|标准委|知识产权局)"
    r"|教育部|科技部|工信部|工业和信息化部|财政部|民政部|人力资源和社会保障部"
)
LOCAL_EVIDENCE = (
    r"北京|天津|上海|重庆|河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东"
    r"|海南|四川|贵州|云南|陕西|甘肃|青海|内蒙古|广西|西藏|宁夏|新疆|香港|澳门"
    r"(?:省|市|区|自治区|特别行政区)?(?:政府|药监|监管|卫健|工信|发改|教育|科技)"
)
GENERIC_COMPANIES = ["公司", "企业", "团队", "研究团队"]
BROAD_COMPANIES = ["apple", "sony"]
AMBIGUOUS_COMPANIES = ["muse", "nimbus", "brainflow"]
DISTINCT_COMPANY_NAMES = ["nimbus studio", "interaxon"]
AMBIGUOUS_DOMAINS = {
    "muse": ["choosemuse.com"], "nimbus": ["nimbusbci.com"], "brainflow": ["brainflow.org"],
}
COMPANY_ALIASES = {
    "BrainCo": ["BrainCo", "强脑科技", "强脑"], "EMOTIV": ["EMOTIV", "Emotiv"],
    "Neurable": ["Neurable"], "Muse": ["Muse", "InteraXon"],
    "NeuroSky": ["NeuroSky", "神念科技"], "脑陆科技": ["脑陆科技", "脑陆"],
    "博睿康": ["博睿康", "Neuracle"], "柔灵科技": ["柔灵科技", "柔灵"],
    "Apple": ["Apple", "苹果公司", "苹果"], "Sony": ["Sony", "索尼"],
    "Nimbus": ["Nimbus", "Nimbus Studio"], "Neurosity": ["Neurosity"], "BrainFlow": ["BrainFlow"],
}
PRIORITY_HINTS = [
    (85, [r"脑电|EEG|electroencephal",
          r"情绪识别|情感识别|情感计算|emotion recognition|affective computing|emotion decoding"]),
    (10, [r"脑电|EEG", r"课堂|classroom", r"认知负荷|cognitive load", r"试验|实验|trial|study",
          r"未公开代码|未开源|no open.source"]),
    (80, [r"非侵入|non.invasive", r"脑电|EEG", r"融资|funding|raises"]),
    (50, [r"(?<!非)植入|(?<!非)侵入|\bimplant(?:ed|able)?\b|(?<!non-)(?<!non )\binvasive\b|\bECoG\b",
          r"融资|funding|raises"]),
    (30, [r"植入|侵入|implant|ECoG", r"瘫痪|paralysis", r"言语|手势|speech|gesture"]),
    (40, [r"脑机|BCI", r"聘|任命|appoint", r"科学家|教授|scientist|professor"]),
    (70, [r"脑机|脑电|BCI", r"专项|产业|industrial", r"补贴|扶持|基金|subsid|fund"]),
    (100, [r"神经数据|脑电数据|neural data", r"隐私|未成年人|privacy|minor"]),
    (90, [r"脑电|EEG", r"大模型|基础模型|foundation model"]),
    (80, [r"耳机|headphone|headset", r"课堂|教育|听觉训练|classroom|education"]),
]
DEFAULT_RELEVANCE = 20
EXCLUDED_TERMS = ["招聘", "股吧", "概念股", "代理加盟", "伪科学"]
BROAD_LISTING_TERMS = r"(?i)脑机|脑电|耳周|神经接口|\bEEG\b|\bBCI\b"
AGGREGATE_PAGE = (
    r"(?i)weekly|week in review|roundup|digest|newsletter|周报|周刊|一周(?:要闻|回顾)|合集|资讯汇总"
)
ROUNDUP_TITLE = r"(?i)weekly|roundup|周报|周刊|一周|\d{1,2}\.\d{1,2}\s*[-—]\s*\d{1,2}\.\d{1,2}"
RELEASE_WORDS = (
    r"(?i)发布|推出|上线|上市|开售|发售|首发|亮相|launch(?:ed|es)?|unveil(?:ed|s)?|introduc(?:ed|es)"
)
GENERIC_PRODUCTS = ["耳机", "脑电耳机", "眼镜", "ai眼镜", "产品", "新品", "设备", "系统"]
GENERIC_BRAND_WORDS = ["technology", "company", "limited"]
STANDARD_NUMBER = r"(?i)\b(YY\s*/?\s*T|GB\s*/?\s*T)\s*(\d{3,6})\s*[-—–－]\s*(20\d{2})"
POLICY_DOCUMENT = r"关于.{2,80}?(?:意见|办法|规定|标准|条例|指南)"
FUNDING_ROUND = r"(?i)(?<![A-Za-z])([A-F](?:\+)?)(?:轮|\s+round)"
NUMBER = r"\d+(?:\.\d+)?"
REPOST_ORIGIN = r"(?:转载自|来源[：:])\s*([^\s，。<]{2,25})"

# --- pages ----------------------------------------------------------------------
META_DATE_KEYS = [
    "article:published_time", "article:published", "date", "pubdate", "publishdate",
    "datepublished", "pubtime", "dc.date.issued", "citation_publication_date", "parsely-pub-date",
]
ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting", "ScholarlyArticle"]
VISIBLE_DATE_CLASSES = [
    "date", "time", "publish-time", "article-info", "releaseTime", "detail-info",
]
# Hosts that state the publication day in one known class.
HOST_DATE_CLASSES = {
    "www.stcn.com": "detail-info",
    "www.chinaventure.com.cn": "releaseTime",
    "chinaventure.com.cn": "releaseTime",
}
FINANCE_HOST_SUFFIX = ".eastmoney.com"
FINANCE_DATE_CLASSES = ["infos", "date", "publish-time"]
FINANCE_DATE_ITEM = ("time-source", "item")
PAGE_CHROME = ["script", "style", "nav", "footer", "header", "aside"]
LISTING_CHROME = ["script", "style", "nav", "footer", "header"]
ARTICLE_TAGS = ["article", "main"]
ARTICLE_CLASSES = ["article-content", "TRS_Editor"]
ACCOUNT_SILENT = ["script", "style", "noscript", "img", "video", "audio"]
BLOCKED_PAGES = ["正在进行安全检测", "Just a moment...", "您访问的网址有误"]

# --- reports --------------------------------------------------------------------
SECTION_ORDER = ["wechat", "github", "academic", "blogs", "products", "news", "security"]
UNUSABLE_SUMMARIES = ["doc", "pdf", "read more", "click here"]
REPO_CATEGORIES = [
    ("AI / 机器学习", "AI / Machine Learning", ["ai", "llm", "machine-learning", "agent", "model"],
     "AI 原型验证与能力集成", "AI prototyping and capability integration"),
    ("开发工具", "Developer Tools", ["developer", "cli", "tool", "sdk", "ide", "terminal"],
     "提升开发、调试或自动化效率", "Improve development, debugging, or automation workflows"),
    ("Web / 应用", "Web / Applications", ["web", "frontend", "backend", "react", "vue", "app"],
     "Web 产品开发与技术选型参考", "Web product development and technology evaluation"),
    ("数据 / 基础设施", "Data / Infrastructure", ["database", "data", "cloud", "kubernetes", "infra"],
     "数据处理或基础设施建设", "Data processing or infrastructure engineering"),
    ("安全", "Security", ["security", "privacy", "vulnerability", "pentest"],
     "安全研究与防护能力建设", "Security research and defensive engineering"),
    ("学习资源", "Learning Resources", ["tutorial", "awesome", "learn", "course", "book"],
     "系统学习与团队知识库建设", "Structured learning and team knowledge bases"),
]
REPO_OTHER = ("其他", "Other", "技术调研与开源方案选型", "Technology research and open-source evaluation")
UNLISTED_LICENSES = ["unknown", "noassertion", "other"]

# --- selection and retention ----------------------------------------------------
MAX_ITEMS, SHORTLIST_ITEMS = 7, 10
CATEGORY_CAP, ACADEMIC_CAP, COMPANY_CAP = 3, 2, 2
ANALYSIS_BUDGET, REFILL_LIMIT, SOURCE_SHARE = 48, 96, 0.25
REPLACEMENT_LIMIT, REPLACEMENT_MARGIN = 1, 1.25
EXPLORATION_RATIO = 0.10
HISTORY_DAYS, LOOKBACK_DAYS = 60, 3
TITLE_SIMILARITY, MIN_TITLE_KEY = 0.92, 14
PRIOR_SIMILARITY, PRIOR_LIMIT = 0.58, 5
LEDGER_DAYS, ERROR_DAYS, CACHE_DAYS, CANDIDATE_DAYS = 365, 90, 30, 30
FIXED_QUERIES_PER_TOPIC, MAX_QUERY_LENGTH = 4, 70
BRIEFING_LIMIT = 18000
