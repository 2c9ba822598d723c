"""Word lists, lookup tables and constants the results depend on."""

# Closed sets of sources, domains and their display labels.
SOURCES = ["github", "hackernews", "bluesky", "devto", "reddit"]
SOURCE_LABELS = {"github": "GitHub", "hackernews": "Hacker News", "bluesky": "Bluesky",
                 "devto": "Dev.to", "reddit": "Reddit"}
DOMAIN_LABELS = {
    "machine_learning": "Machine Learning", "devops_k8s": "DevOps / Kubernetes",
    "open_source_trending": "Trending Open-Source", "developer_tools": "Developer Tools",
    "cybersecurity": "Cybersecurity", "frontend_web": "Frontend (React/Web)",
    "b2b_saas": "B2B SaaS", "blockchain": "Blockchain", "python_data_eng": "Python Data Eng",
    "gamedev_cpp": "GameDev (C++)", "ai_research": "AI Research",
    "embedded_systems": "Embedded (C/RTOS)", "cloud_apis": "Cloud APIs",
    "mobile_dev": "Mobile Dev (iOS/Flutter)", "beginner_coding": "Beginner Coding",
}
DOMAINS = list(DOMAIN_LABELS)
DOMAIN_ALIASES = {"blockchain_web3": "blockchain", "embedded_iot": "embedded_systems"}
PLATFORM_ALIASES = {"blogs": "devto", "social": "bluesky"}

# Terms that place a repository in a domain (first domain with a hit wins).
DOMAIN_TERMS = {
    "machine_learning": ["machine learning", "machinelearning"],
    "devops_k8s": ["devops k8s", "devops", "kubernetes"],
    "open_source_trending": ["open source trending", "open source", "opensource", "github"],
    "developer_tools": ["developer tools", "tooling", "productivity"],
    "cybersecurity": ["cybersecurity", "security"],
    "frontend_web": ["frontend web", "react", "webdev", "javascript", "typescript", "vue", "svelte"],
    "b2b_saas": ["b2b saas", "saas", "startup"],
    "blockchain": ["blockchain", "web3", "solidity"],
    "python_data_eng": ["python data eng", "data engineering", "python", "dataengineering", "jupyter notebook"],
    "gamedev_cpp": ["gamedev cpp", "game development", "gamedev", "cpp", "c++", "cmake"],
    "ai_research": ["ai research", "large language model", "machinelearning"],
    "embedded_systems": ["embedded systems", "embedded", "iot", "rust", "zig"],
    "cloud_apis": ["cloud apis", "aws", "cloud"],
    "mobile_dev": ["mobile dev", "flutter", "android", "swift", "kotlin", "dart"],
    "beginner_coding": ["beginner coding", "beginner programming", "beginners", "codenewbie"],
}
DEFAULT_REPO_DOMAIN = "open_source_trending"

# Activity buckets and the sources each one holds.
BUCKETS = ["contribute", "learn", "discuss", "news"]
BUCKET_SOURCES = {"contribute": ["github"], "learn": ["devto"],
                  "discuss": ["reddit", "bluesky"], "news": ["hackernews"]}
SOURCE_BUCKET = {"github": "contribute", "devto": "learn", "reddit": "discuss",
                 "bluesky": "discuss", "hackernews": "news"}
DEFAULT_BUCKET = "discuss"

# Scoring signals, per-mode weights and platform preferences.
SIGNALS = ["relevance", "community_health", "visibility", "velocity", "standout",
           "recency", "discussion", "platform_fit", "effort_fit", "contribution_worth"]
MODE_WEIGHTS = {
    "contribute": {"relevance": 0.30, "contribution_worth": 0.20, "platform_fit": 0.15,
                   "standout": 0.12, "community_health": 0.10, "visibility": 0.08,
                   "effort_fit": 0.05},
    "discuss": {"relevance": 0.33, "community_health": 0.18, "discussion": 0.15,
                "platform_fit": 0.13, "standout": 0.13, "visibility": 0.03, "effort_fit": 0.05},
    "monitor": {"velocity": 0.40, "recency": 0.25, "relevance": 0.20, "visibility": 0.15},
    "promote": {"relevance": 0.33, "visibility": 0.22, "discussion": 0.18,
                "platform_fit": 0.12, "recency": 0.08, "effort_fit": 0.07},
}
MODE_PLATFORM_FIT = {
    "contribute": {"github": 1.0, "devto": 0.45, "hackernews": 0.45, "reddit": 0.45, "bluesky": 0.30},
    "discuss": {"reddit": 1.0, "hackernews": 1.0, "bluesky": 0.95, "devto": 0.85, "github": 0.82},
    "monitor": {"github": 1.0, "hackernews": 1.0, "bluesky": 1.0, "devto": 1.0, "reddit": 1.0},
    "promote": {"reddit": 1.0, "hackernews": 1.0, "devto": 0.95, "bluesky": 0.90, "github": 0.60},
}
DEFAULT_PLATFORM_FIT = 0.5
EFFORT_AWARE_MODES = ["contribute", "discuss", "promote"]
SPLIT_BASE = {
    "contribute": {"contribute": 50, "learn": 25, "discuss": 15, "news": 10},
    "discuss": {"contribute": 22, "learn": 13, "discuss": 45, "news": 20},
    "monitor": {"contribute": 12, "learn": 18, "discuss": 30, "news": 40},
    "promote": {"contribute": 12, "learn": 16, "discuss": 42, "news": 30},
}
PINNED_MODES = [("sofia", "contribute"), ("david", "discuss"), ("lina", "monitor"), ("raj", "promote")]

# Phrases that reveal an engagement mode or an experience level.
MONITOR_WORDS = ["monitor", "trend", "surface", "spot", "before they go mainstream",
                 "breadth", "rising", "fast-growing", "emerging"]
PROMOTE_WORDS = ["promote", "awareness", "marketing", "product is relevant", "integration",
                 "partnership", "grow awareness", "relevant to the discussion"]
CONTRIBUTE_WORDS = ["contribute", "portfolio", "good first issue", "repos to contribute",
                    "fix", "build a visible"]
DISCUSS_WORDS = ["thought leadership", "expert commentary", "discussion", "commentary",
                 "high-signal", "engage with"]
NEWBIE_WORDS = ["student", "beginner", "newbie", "first ", "first-", "graduat", "early-career",
                "junior", "comfortable with python", "new to", "portfolio", "good first issue",
                "good-first"]
EXPERT_WORDS = ["senior", "expert", "yrs", "5 yr", "mid-career", "years of", "lead ", "principal",
                "founder", "experienced", "thought leader", "deep kubernetes", "deep "]
MODE_VERBS = {"contribute": "build things and contribute code",
              "discuss": "join high-signal conversations where your take matters",
              "monitor": "track what is rising before it goes mainstream",
              "promote": "find the right places to mention your work"}
EXPERIENCE_CLAUSES = {
    "newbie": "You are earlier in the journey, so we lean a little more on learning and lower-pressure wins. ",
    "expert": "You have real depth, so we lean into hands-on work and high-signal discussion. ",
    "mid": ""}
SIGNAL_REASONS = {
    "relevance": "matches your interests", "community_health": "active, healthy community",
    "visibility": "high visibility potential", "velocity": "rising fast",
    "standout": "room to stand out (few contributors)", "recency": "fresh",
    "discussion": "live discussion to join", "platform_fit": "on your primary platform",
    "effort_fit": "quick to engage",
    "contribution_worth": "a worthwhile, well-run repo to contribute to"}
PRIORITY_LABELS = {
    "relevance": "topics that match you", "community_health": "active communities",
    "visibility": "high-visibility posts", "velocity": "fast-rising topics",
    "standout": "room to stand out", "recency": "fresh posts", "discussion": "live discussions",
    "platform_fit": "your main platform", "effort_fit": "quick wins",
    "contribution_worth": "well-run repos to contribute to"}

# Feedback rewards, learning rate, engagement floors, event weights.
REWARDS = {"engage": 1.0, "save": 0.8, "skip": 0.0, "dismiss": 0.0}
LEARNING_RATE = 0.30
RISING_FLOORS = {"github": 4, "devto": 2, "bluesky": 4, "reddit": 15, "hackernews": 8}
DEFAULT_RISING_FLOOR = 5
ACTIVITY_WEIGHTS = {"PushEvent": 1, "PullRequestEvent": 3, "IssuesEvent": 3,
                    "IssueCommentEvent": 2, "PullRequestReviewCommentEvent": 2}

# Phrases that raise an issue's write-up quality.
REPRO_WORDS = ["reproduce", "steps to", "expected", "actual", "screenshot", "example"]
NEWCOMER_WORDS = ["good first issue", "beginner", "newcomer", "help wanted"]
GOOD_FIRST_WORDS = ["good first issue", "good-first-issue", "beginner"]

# Term stop list, keyword stop list, generic tags that make no subtopic.
TERM_STOP = """the and for with that this from your you are has have was were will can
into out off over under more most less than then them they their our out new now get got
how why what when who which where about just like also able able using use used via per
not but all any one two via vs etc etc. com www http https org net app api app io
github com issue issuehub pull request post posts comment thread repo repos project projects
code coding open source help need want make build building add added update updated fix fixed
release version support feature features guide tutorial intro learn learning ask show tell""".split()
KEYWORD_STOP = ["the", "for", "and", "with", "add", "fix", "update", "new", "data", "node",
                "issue", "post", "how", "why", "your", "you", "this", "that", "from", "into"]
TOPIC_STOP = [
    "discussion", "built", "made", "using", "use", "new", "data", "code", "help", "question", "show",
    "showdev", "project", "best", "good", "need", "work", "app", "tools", "tool", "tips", "guide",
    "tutorial", "blog", "article", "ai", "programming", "github", "documentation", "help wanted",
    "good first issue", "i will not promote", "i will promote it", "promotional", "promote", "beginner",
    "beginners", "news", "release", "update", "personal project showcase", "alternatives", "opensource",
    "open source", "productivity", "other", "enhancement", "career", "needs help", "general", "bug",
    "feature", "wip", "todo", "misc", "meta", "off topic", "advice", "resources", "learning"]
