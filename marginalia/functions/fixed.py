"""Fixed values of the text rules: patterns, word lists, weights and limits, all of them parameters of the operators."""

# Question types in the order they are tried, with the words that show them.
QUESTION_WORDS = {
    "what": ["what", "which"],
    "how": ["how"],
    "why": ["why"],
    "when": ["when"],
    "where": ["where"],
    "who": ["who", "whom"],
    "definition": ["define", "definition", "meaning", "means"],
    "comparison": ["compare", "comparison", "difference", "versus", "vs"],
    "procedure": ["steps", "process", "procedure", "guide", "tutorial"],
    "factual": ["is", "are", "does", "do", "can", "will", "would", "should"],
}
HELP_WORDS = ["help", "assist", "support"]
EXPLAIN_WORDS = ["explain", "describe", "tell"]
# Topics and the substrings that show them; then the fallback groups in order.
TOPIC_WORDS = {
    "academic": ["course", "class", "degree", "program", "curriculum", "syllabus", "credit", "semester", "professor", "instructor"],
    "administrative": ["admission", "enrollment", "registration", "fee", "tuition", "scholarship", "financial", "aid", "deadline"],
    "campus": ["facility", "library", "dormitory", "housing", "dining", "parking", "recreation", "gym", "health"],
    "technical": ["requirement", "prerequisite", "policy", "procedure", "application", "system", "portal", "website"],
}
TOPIC_FALLBACKS = [("academic", ["course", "class", "study", "learn"]), ("administrative", ["apply", "admission", "enroll"]), ("campus", ["campus", "location", "facility"])]
# English stop words of the question tier.
STOPWORDS_EN = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "can", "may", "might", "must", "this", "that", "these", "those"]
# Suspicious input, and answers that refuse or report an error (lower case).
SUSPICIOUS = r"<script|javascript:|eval\(|document\.|window\.|\.exe([^\p{L}\p{N}_]|$)|hack|crack|exploit|sql.*injection"
BAD_ANSWER = r"i apologize.*unable to|i cannot.*provide|error.*occurred|something went wrong|try again later"
# Abbreviations written out, in order.
ABBREVIATIONS = [("u", "you"), ("ur", "your"), ("r", "are"), ("tho", "though"), ("thru", "through")]
# Categories of web pages in order, with their substrings.
PAGE_CATEGORIES = {
    "education": ["course", "tutorial", "learn", "guide", "education", "training", "lesson", "study", "academic", "university", "school", "class"],
    "technical": ["api", "code", "programming", "developer", "software", "algorithm", "technical", "documentation", "implementation", "framework"],
    "research": ["research", "study", "analysis", "paper", "publication", "findings", "methodology", "data", "results", "experiment"],
    "news": ["news", "announcement", "update", "press", "release", "breaking", "latest", "report", "event", "happening"],
    "product": ["product", "service", "feature", "solution", "tool", "application", "platform", "system"],
    "about": ["about", "company", "team", "mission", "vision", "history", "organization", "who we are", "our story"],
    "support": ["help", "support", "faq", "troubleshoot", "problem", "issue", "contact", "assistance", "customer service"],
    "blog": ["blog", "post", "article", "opinion", "editorial", "commentary"],
}
# URL endings and path parts of addresses that are no pages.
EXCLUDED_ENDINGS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "bmp", "mp3", "mp4", "avi", "mov", "wmv", "css", "js", "xml", "rss", "atom", "zip", "tar", "gz", "rar", "7z", "exe", "dmg", "apk"]
EXCLUDED_PARTS = ["/wp-admin/", "/admin/", "/login", "/logout", "/register", "/cart", "/checkout", "/feed/", "/wp-json/", "/api/"]
# Field weights of the term score.
FIELD_BOOSTS = {"title": 2.0, "summary": 1.3, "keywords": 1.5, "search_text": 1.0, "structured": 0.8}
# Stop words of the frequency tier, both languages.
BASIC_STOPWORDS = ["the", "and", "for", "with", "this", "that", "من", "في", "على", "إلى", "هذا", "هذه", "التي", "الذي", "كان", "كانت", "يكون", "تكون"]
#: Letters of Arabic script, as class contents for regular expressions.
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"
# Texts of contexts and prompts: nothing found, marks of what was cut.
EMPTY_CONTEXT = "No specific institutional data was found for this query. Please provide general guidance based on your training."
ENTRY_CUT = "...[truncated]\n\n"
CONTEXT_CUT = "...[Content truncated due to length limits]"
PROMPT_CUT = "\n...[Truncated]"
# Parts of words that raise the confidence in English.
ENGLISH_HINTS = ["the", "and", "or", "but", "what", "how", "why", "when", "where", "who"]
# Frequent short words of each language, for guessing the language of a question.
COMMON_WORDS = {
    "en": ["the", "and", "of", "to", "is", "are", "for", "with", "what", "how", "when", "can", "do", "you", "my", "this", "that", "it", "be", "in"],
    "fr": ["le", "la", "les", "des", "et", "est", "pour", "avec", "que", "je", "vous", "une", "dans", "sur", "au", "comment", "quand", "mon", "ce", "un"],
    "de": ["der", "die", "das", "und", "ist", "ich", "sie", "mit", "nicht", "ein", "eine", "wie", "wann", "kann", "zu", "im", "auf", "den", "dem", "für"],
    "es": ["el", "la", "los", "las", "y", "es", "para", "con", "que", "una", "en", "mi", "se", "del", "como", "cuando", "por", "un", "qué", "cómo"],
}
# Markup of pages: tags whose text is no content, tags without an end, tags that end a paragraph, classes of the content's element,
# words that are no keywords.
DROPPED_TAGS = ["script", "style", "noscript", "header", "nav", "footer", "aside"]
VOID_TAGS = ["meta", "link", "br", "img", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"]
CLOSE_PARAGRAPH = ["p", "ul", "ol", "div", "table", "section", "h1", "h2", "h3", "h4", "h5", "h6"]
CONTENT_CLASSES = ["content", "main", "article", "post-body", "entry"]
PAGE_STOPWORDS = ["the", "and", "for", "with", "this", "that", "our", "are", "you", "your", "not", "all", "from", "more", "about", "also", "have", "was", "but", "can", "page", "site", "click", "here", "content"]
# Answers when every model failed, by a part of the error, and the general one.
FALLBACK_ANSWERS = {
    "rate limit": "I'm currently experiencing high demand. Please try again in a few minutes.",
    "timeout": "The request is taking longer than expected. Please try again with a shorter question.",
}
GENERAL_FALLBACK = "I apologize, but I'm currently experiencing technical difficulties. Please try again in a few moments."
