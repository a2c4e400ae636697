"""Word lists, domain sets, weights and labels that results depend on."""

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "ref", "referrer", "source", "campaign", "fbclid", "gclid", "mc_cid", "mc_eid",
    "_ga", "yclid", "msclkid",
]

STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "as", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "need", "its", "it", "this", "that", "these", "those", "how", "why", "what", "when",
    "where", "who", "which", "new", "says", "said", "report", "reports", "using", "use",
    "via", "now", "just", "more", "than",
]

RELEVANCE_KEYWORDS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network",
    "large language model", "llm", "generative ai", "foundation model", "transformer",
    "diffusion model", "gpt", "claude", "gemini", "llama", "mistral", "grok",
    "stable diffusion", "dall-e", "sora", "whisper", "copilot", "openai", "anthropic",
    "deepmind", "google ai", "meta ai", "hugging face", "perplexity", "xai", "stability ai",
    "cohere", "ai agent", "rag", "retrieval augmented", "fine-tuning", "fine tuning",
    "embedding", "vector database", "multimodal", "reasoning model", "ai safety",
    "ai alignment", "hallucination", "benchmark", "natural language processing", "nlp",
    "computer vision", "gpu cluster", "tpu", "ai chip", "inference", "nvidia h100",
    "ai assistant", "chatbot", "ai model", "language model", "ai research",
    "reinforcement learning", "rlhf", "ai startup", "ai funding",
]

OFFICIAL_DOMAINS = [
    "openai.com", "anthropic.com", "deepmind.google", "blog.research.google", "ai.meta.com",
    "blogs.microsoft.com", "blogs.nvidia.com", "huggingface.co", "mistral.ai", "x.ai",
    "perplexity.ai", "stability.ai", "cohere.com",
]

# Domain classes of the trust score.
TRUST_TIER1 = [
    "reuters.com", "apnews.com", "bbc.co.uk", "nytimes.com", "wsj.com", "theguardian.com",
    "ft.com", "bloomberg.com",
]
TRUST_TECH = [
    "techcrunch.com", "venturebeat.com", "technologyreview.com", "wired.com", "theverge.com",
    "arstechnica.com", "zdnet.com", "arxiv.org", "paperswithcode.com", "github.com",
    "news.ycombinator.com", "producthunt.com",
]

# Domain classes of the priority score (a different split from the trust score).
PRIORITY_TIER1 = [
    "reuters.com", "bloomberg.com", "technologyreview.com", "techcrunch.com",
    "venturebeat.com", "arxiv.org", "paperswithcode.com",
]
PRIORITY_TIER2 = [
    "wired.com", "theverge.com", "arstechnica.com", "zdnet.com", "github.com",
    "news.ycombinator.com",
]

EVENT_BONUS = {
    "model_release": 25.0, "product_launch": 20.0, "funding": 15.0, "acquisition": 20.0,
    "research_paper": 10.0, "benchmark": 12.0, "open_source_release": 15.0,
    "security_incident": 18.0, "government_regulation": 20.0, "startup_launch": 8.0,
    "api_release": 10.0, "infrastructure": 8.0, "gpu": 12.0, "ai_agent": 15.0,
    "robotics": 12.0, "developer_tool": 10.0, "framework": 10.0, "coding_ai": 12.0,
    "healthcare_ai": 10.0, "finance_ai": 8.0, "education_ai": 6.0,
}

HIGH_IMPACT_COMPANIES = [
    "OpenAI", "Anthropic", "Google", "Google DeepMind", "Microsoft", "Meta", "NVIDIA",
    "Apple", "Amazon", "Tesla", "xAI",
]

PRIORITY_WEIGHTS = {
    "freshness": 0.20, "source_trust": 0.20, "source_count": 0.10, "industry_impact": 0.15,
    "research_sig": 0.10, "product_launch": 0.10, "funding": 0.05, "gov_regulation": 0.05,
    "social_signal": 0.05,
}

# (source, tier, category, company)
SOURCE_REGISTRY = [
    ("openai_blog", 0, "official", "OpenAI"),
    ("google_ai_blog", 0, "official", "Google"),
    ("deepmind_blog", 0, "official", "Google DeepMind"),
    ("huggingface_blog", 0, "official", "Hugging Face"),
    ("arxiv_ai", 1, "research", None),
    ("techcrunch_ai", 1, "media", None),
    ("venturebeat_ai", 1, "media", None),
    ("mit_tech_review", 1, "media", None),
    ("bloomberg_tech", 1, "media", None),
    ("arstechnica_ai", 1, "media", None),
    ("github_trending_ai", 2, "developer", None),
    ("github_releases_ai", 2, "developer", None),
    ("hacker_news", 2, "community", None),
    ("producthunt_ai", 2, "community", None),
    ("google_news_ai", 3, "aggregator", None),
]
SOURCE_ALIASES = {"arxiv": "arxiv_ai"}
DEFAULT_TIER = 9

TOPIC_EXPANSIONS = {
    "pytorch": ["deep learning", "ml frameworks", "torch", "model training"],
    "mcp": ["model context protocol", "agents", "tool calling", "developer tools"],
    "rag": ["retrieval", "embeddings", "vector database", "knowledge systems"],
    "agents": ["ai agents", "tool use", "workflows", "autonomous systems"],
    "quantization": ["model compression", "inference optimization", "edge ai"],
    "llms": ["language models", "reasoning", "model releases", "nlp"],
}
AFFINITY_WEIGHTS = {"bookmark": 5.0, "topic": 3.0, "category": 3.5, "company": 2.5, "profile": 1.5}
EXPANSION_FACTOR = 0.55

CATEGORIES = [
    "LLMs", "AI Agents", "Research", "Robotics", "Healthcare", "Finance", "Coding",
    "Open Source", "Enterprise AI", "Safety", "Computer Vision", "NLP", "Multimodal",
    "Hardware", "General AI", "Education", "Infrastructure",
]
SENTIMENTS = ["positive", "negative", "neutral"]
URGENCIES = ["breaking", "high", "medium", "low"]
EVENT_TYPES = list(EVENT_BONUS)

# Required fields of a model response and the JSON kinds each accepts, in check order.
REQUIRED_FIELDS = [
    ("summary", "string"), ("key_takeaways", "array"), ("why_it_matters", "string"),
    ("category", "string"), ("keywords", "array"), ("tags", "array"), ("companies", "array"),
    ("sentiment", "string"), ("urgency", "string"), ("confidence_score", "number"),
    ("importance_score", "number"), ("reading_time_minutes", "integer"),
]

FEED_EXCLUDED_SOURCES = ["github_trending_ai", "producthunt_ai"]
FEED_TRUSTED_MEDIA = ["techcrunch_ai", "venturebeat_ai", "mit_tech_review", "google_news_ai"]
FEED_BLOCKLIST = [
    "github trending", "stars today", "pytorch_geometric", "kohya", "how to use", "tutorial",
    "tailwindcss", "daisyui", "headscale", "posthog", "supabase repos", "flutter",
    "rust crate", "npm package", "saadeghi", "juanfont", "bmaltais", "chidiwilliams",
]
FEED_MARKET = [
    "launches", "release", "released", "announces", "unveiled", "introduced", "raises",
    "funding", "acquisition", "acquires", "acquired", "partnership", "valuation", "ipo",
    "investment", "series a", "series b", "series c", "beats", "surpasses", "outperforms",
    "competition", "competitor", "rival", "bans", "blocks", "sues", "lawsuit", "regulation",
    "eu ai act",
]
FEED_MODEL = [
    "gpt", "gemini", "claude", "llama", "mistral", "grok", "qwen", "phi", "new model",
    "model release", "open source model", "fine-tuning", "parameter", "context window",
    "multimodal", "vision model", "reasoning", "chain-of-thought", "rlhf",
    "instruction-tuned", "sota", "state-of-the-art", "benchmark", "leaderboard",
]
FEED_RESEARCH = [
    "research", "paper", "study", "breakthrough", "method", "approach", "agent", "agentic",
    "rag", "retrieval", "embedding", "transformer", "diffusion", "reinforcement learning",
    "hallucination", "alignment", "safety", "interpretability", "efficiency", "inference",
    "training",
]

# First matching rule wins.
CATEGORY_RULES = [
    ("Research", ["research", "paper", "arxiv"]),
    ("AI Agents", ["agent", "reasoning", "decision"]),
    ("Robotics", ["robot", "robotic", "hardware", "nvidia"]),
    ("Coding", ["code", "coding", "developer", "programmer"]),
    ("Open Source", ["open source", "open-source", "apache"]),
    ("Healthcare", ["medical", "health", "clinical", "hospital"]),
    ("Finance", ["finance", "bank", "stock", "funding", "raises"]),
]
DEFAULT_CATEGORY = "LLMs"

INTERRUPT_TYPES = [
    "model_release", "product_launch", "api_release", "security_incident",
    "government_regulation", "open_source_release", "infrastructure", "gpu",
]
ALERT_EMOJI = {
    "model_release": "🤖", "product_launch": "🚀", "funding": "💰", "acquisition": "🤝",
    "research_paper": "📄", "benchmark": "📊", "open_source_release": "🔓",
    "security_incident": "⚠️", "government_regulation": "⚖️", "gpu": "📈", "ai_agent": "🧠",
    "robotics": "🤖", "coding_ai": "💻",
}
DEFAULT_EMOJI = "📰"
ALERT_PREFIX = {
    "product_launch": "🚀 Product Launch", "gpu": "📈 AI Hardware",
    "infrastructure": "📈 AI Hardware", "government_regulation": "⚖️ AI Regulation",
    "acquisition": "🤝 AI Acquisition", "research_paper": "📄 AI Research",
    "security_incident": "⚠️ AI Security",
}

LISTING_NEWS_DOMAINS = [
    "openai.com", "anthropic.com", "deepmind.google", "ai.meta.com", "techcrunch.com",
    "venturebeat.com", "technologyreview.com", "arxiv.org", "wired.com", "theverge.com",
    "arstechnica.com", "reuters.com", "bloomberg.com", "huggingface.co", "mistral.ai",
    "github.com", "nature.com", "science.org",
]
REPO_KEYWORDS = [
    "llm", "ai", "ml", "machine-learning", "deep-learning", "neural", "transformer",
    "diffusion", "language-model", "chatbot", "gpt", "llama", "stable-diffusion",
    "generative", "embedding", "rag", "agent", "multimodal", "vision", "nlp",
    "reinforcement-learning",
]

# Mentor texts, (topic, tool, action) used when no article fits, and message templates.
MENTOR_BACKLOG = [
    ("AI agents", "Model Context Protocol",
     "Build a tiny tool-calling workflow and write down where context breaks."),
    ("LLM evaluation", "promptfoo or OpenAI Evals",
     "Create three task-specific checks for a feature you already know well."),
    ("retrieval systems", "FAISS or pgvector",
     "Compare one keyword query against one embedding query on the same notes."),
    ("model deployment", "vLLM",
     "Read one deployment guide and list the serving bottlenecks it solves."),
]
MENTOR_TEMPLATES = [
    "Focus on {topic} today. Try {tool}, because {reason}. Action: {action}",
    "A useful career move today is {topic}: explore {tool}. The signal is {reason}. Next step: {action}",
    "Your brief points toward {topic}. Use {tool} as the hands-on anchor; {reason}. Then {action}",
    "For skill growth, spend one focused block on {topic}. {tool} is the practical entry point because {reason}. {action}",
    "Today's best mentor nudge: {topic}. Pair it with {tool}; {reason}. Keep it concrete: {action}",
]
MENTOR_FALLBACK_REASON = "today's brief did not have a strong enough profile match"
MENTOR_ACTION = "Skim the source, then write one implementation note you can reuse."
MENTOR_ACTIONS = {
    "model_release": "Read the docs or release notes and build a 30-minute toy integration.",
    "api_release": "Read the docs or release notes and build a 30-minute toy integration.",
    "developer_tool": "Read the docs or release notes and build a 30-minute toy integration.",
    "framework": "Read the docs or release notes and build a 30-minute toy integration.",
    "research_paper": "Read the abstract and reproduce one diagram, metric, or limitation in your own words.",
    "security_incident": "Check whether your current stack has exposure and note one mitigation.",
}

DEGRADED_SUMMARY = (
    "AI summary could not be generated right now. "
    "Open the original source for the full article: "
)
DEGRADED_WHY = "No validated AI analysis was available; read the source before acting."
BRIEF_ALERT_TITLE = "📰 Your AI Daily Brief is Ready"
