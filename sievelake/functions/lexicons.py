"""Fixed vocabularies. Every operator takes them as parameters; these are the defaults."""

# Word lists, patterns and tables that results depend on, in their order of precedence.

SKILLS = (
    "python", "java", "javascript", "typescript", "c++", "c#", "golang", "go", "rust", "kotlin", "swift", "dart", "php", "ruby", "scala", "r",
    "matlab", "solidity", "bash", "shell", "powershell", "sql", "c", "react", "react native", "next.js", "angular", "vue", "nuxt", "svelte",
    "sveltekit", "flutter", "ios", "android", "html", "html5", "css", "css3", "tailwind", "bootstrap", "sass", "redux", "zustand", "vite", "webpack",
    "node.js", "node", "express", "django", "flask", "fastapi", "spring", "spring boot", ".net", "asp.net", "nest.js", "laravel", "rails", "graphql",
    "rest", "restful", "grpc", "websocket", "websockets", "trpc", "microservices", "system design", "api design", "oop", "data structures",
    "algorithms", "postgresql", "postgres", "mysql", "mongodb", "redis", "sqlite", "oracle", "cassandra", "dynamodb", "elasticsearch", "snowflake",
    "bigquery", "faiss", "chromadb", "pinecone", "qdrant", "weaviate", "supabase", "firebase", "aws", "azure", "gcp", "google cloud", "docker",
    "kubernetes", "terraform", "ansible", "helm", "jenkins", "github actions", "gitlab ci", "ci/cd", "linux", "nginx", "git", "github", "gitlab",
    "prometheus", "grafana", "devops", "cloud architecture", "machine learning", "deep learning", "data analysis", "data engineering", "nlp",
    "computer vision", "llm", "llms", "rag", "langchain", "llamaindex", "crewai", "autogen", "mcp", "hugging face", "vllm", "ollama", "fine-tuning",
    "pytorch", "tensorflow", "keras", "scikit-learn", "opencv", "pandas", "numpy", "polars", "pyarrow", "spark", "hadoop", "kafka", "airflow",
    "tableau", "power bi", "dbt", "jest", "pytest", "junit", "cypress", "playwright", "selenium", "postman", "unit testing", "tdd", "cybersecurity",
    "penetration testing", "agile", "scrum", "jira", "figma",
)

POWER_VERBS = (
    "architected", "automated", "benchmarked", "boosted", "centralized", "containerized", "deployed", "designed", "engineered", "fine-tuned",
    "implemented", "innovated", "migrated", "optimized", "orchestrated", "overhauled", "pioneered", "refactored", "scaled", "spearheaded",
    "streamlined", "transformed", "unified", "upgraded",
)

STANDARD_VERBS = (
    "accelerated", "achieved", "analyzed", "applied", "authored", "built", "calculated", "compiled", "configured", "constructed", "converted",
    "coordinated", "created", "debugged", "delivered", "developed", "devised", "diagnosed", "directed", "discovered", "drafted", "established",
    "evaluated", "executed", "expanded", "formulated", "generated", "identified", "integrated", "launched", "maintained", "managed", "modeled",
    "modified", "monitored", "programmed", "published", "queried", "reduced", "resolved", "restructured", "retrieved", "reviewed", "revised",
    "saved", "secured", "structured", "tested", "tracked", "trained", "validated", "verified", "wrote",
)

PASSIVE_PHRASES = (
    "assisted with", "helped with", "worked on", "responsible for", "duties included", "tasked with", "involved in", "participated in", "handled",
    "contributed to",
)

STOP_WORDS = (
    "the", "and", "for", "with", "you", "your", "our", "are", "will", "that", "this", "from", "have", "has", "who", "were", "was", "not", "but",
    "all", "any", "can", "its", "their", "they", "them", "then", "than", "into", "out", "about", "across", "after", "also", "been", "being", "best",
    "both", "each", "more", "most", "must", "need", "other", "over", "such", "some", "team", "teams", "work", "working", "role", "job", "able",
    "strong", "good", "years", "year", "plus", "etc", "new", "use", "using", "within", "while", "when", "what", "which", "would", "should", "could",
    "every", "ensure", "help", "join", "looking", "ideal", "candidate", "candidates", "company", "responsibilities", "requirements",
    "qualifications", "preferred", "experience", "skills", "knowledge",
)

CORPORATE_WORDS = (
    "responsibilities", "requirements", "opportunity", "experience", "candidate", "qualifications", "position", "role", "company", "working",
    "looking", "ability", "knowledge", "skills", "understanding", "team", "teams", "strong", "excellent", "good", "years", "degree", "bachelor",
    "master", "plus", "preferred", "bonus", "hands-on", "environment", "solutions", "business", "develop", "build", "design", "support", "create",
)

HIGH_BAR_SIGNALS = (
    "distributed systems", "concurrency", "multithreading", "event-driven", "microservices", "kafka", "rabbitmq", "redis", "caching",
    "database indexing", "sharding", "connection pooling", "rate limiting", "jwt", "oauth", "sandboxed", "docker", "kubernetes", "grpc",
    "websockets", "ci/cd", "unit testing", "system design", "memory optimization", "p2p", "local embeddings", "rag", "vector search", "faiss",
    "multi-agent", "mcp", "leetcode", "codeforces", "hackathon", "patent", "research paper", "pypi", "npm package", "open source",
)

DEFAULT_ARC = "Student / Entry-Level (Undecided)"
ROLE_ARCS = (
    ("Generative AI / LLM Builder", (
        "llm", "large language model", "gpt", "rag", "retrieval augmented", "langchain", "langgraph", "vector database", "pinecone",
        "weaviate", "chromadb", "llamaindex", "fine-tun", "prompt engineering", "agent", "multi-agent", "semantic kernel", "diffusion",
        "stable diffusion", "text-to-image", "genai", "generative ai", "transformer", "bert", "hugging face", "llama", "mistral", "qwen",
        "deepseek",
    )),
    ("AI / ML Engineer", (
        "machine learning", "deep learning", "neural network", "pytorch", "tensorflow", "keras", "scikit-learn", "xgboost", "computer vision",
        "nlp", "reinforcement learning", "mlops", "model training", "inference", "onnx", "opencv", "speech", "recommendation",
    )),
    ("Data / Analytics Engineer", (
        "data engineering", "etl", "spark", "hadoop", "kafka", "airflow", "dbt", "snowflake", "bigquery", "data warehouse", "data pipeline",
        "sql", "redshift", "databricks", "power bi", "tableau", "looker", "analytics", "statistics", "pandas", "numpy",
    )),
    ("DevOps / MLOps / SRE", (
        "devops", "mlops", "sre", "kubernetes", "docker", "terraform", "ansible", "ci/cd", "jenkins", "github actions", "gitlab ci",
        "prometheus", "grafana", "observability", "site reliability", "helm", "argo", "istio",
    )),
    ("Cloud / Infrastructure", (
        "aws", "azure", "gcp", "google cloud", "cloud architecture", "serverless", "lambda", "ec2", "s3", "cloudformation", "networking",
        "vpc", "iam",
    )),
    ("Backend / Platform Engineer", (
        "backend", "api", "microservices", "node.js", "django", "fastapi", "spring", "go ", "golang", "rust", "java ", "graphql", "rest api",
        "postgres", "redis", "rabbitmq", "system design", "scalability",
    )),
    ("Frontend / Product Engineer", (
        "react", "vue", "angular", "svelte", "next.js", "tailwind", "typescript", "frontend", "front-end", "ui ", "spa", "redux", "webpack",
        "vite",
    )),
    ("Mobile Engineer", (
        "android", "ios", "swift", "kotlin", "flutter", "react native", "mobile",
    )),
    ("Security / Cybersecurity", (
        "cybersecurity", "penetration testing", "pentest", "security", "owasp", "cryptography", "infosec", "soc", "threat", "vulnerability",
        "compliance",
    )),
    ("QA / SDET", (
        "qa", "sdet", "selenium", "cypress", "playwright", "jest", "pytest", "test automation", "junit", "自动化测试",
    )),
    ("Design / UX", (
        "ux", "ui design", "figma", "sketch", "user research", "prototyping", "design system",
    )),
    ("Product / Strategy", (
        "product manager", "product owner", "roadmap", "strategy", "stakeholder", "agile coach",
    )),
)

#: name, category, whether domestic
AI_TOOLS = (
    ("openai", "foundation-model", False), ("gpt-4", "foundation-model", False), ("gpt-5", "foundation-model", False),
    ("chatgpt", "foundation-model", False), ("claude", "foundation-model", False), ("anthropic", "foundation-model", False),
    ("gemini", "foundation-model", False), ("palm", "foundation-model", False), ("llama", "foundation-model", False),
    ("mistral", "foundation-model", False), ("mixtral", "foundation-model", False), ("cohere", "foundation-model", False),
    ("grok", "foundation-model", False), ("qwen", "foundation-model", True), ("tongyi", "foundation-model", True),
    ("dashscope", "foundation-model", True), ("deepseek", "foundation-model", True), ("glm", "foundation-model", True),
    ("chatglm", "foundation-model", True), ("zhipu", "foundation-model", True), ("ernie", "foundation-model", True),
    ("wenxin", "foundation-model", True), ("baichuan", "foundation-model", True), ("kimi", "foundation-model", True),
    ("moonshot", "foundation-model", True), ("yi-", "foundation-model", True), ("01.ai", "foundation-model", True),
    ("doubao", "foundation-model", True), ("abab", "foundation-model", True), ("minimax", "foundation-model", True),
    ("sensechat", "foundation-model", True), ("step", "foundation-model", True), ("internlm", "foundation-model", True),
    ("falcon", "foundation-model", True), ("langchain", "agent-framework", False), ("langgraph", "agent-framework", False),
    ("llamaindex", "agent-framework", False), ("semantic kernel", "agent-framework", False), ("crewai", "agent-framework", False),
    ("autogen", "agent-framework", False), ("dify", "agent-framework", False), ("cozel", "agent-framework", False),
    ("rag", "agent-framework", False), ("multi-agent", "agent-framework", False), ("agent", "agent-framework", False),
    ("pinecone", "vector-store", False), ("weaviate", "vector-store", False), ("chroma", "vector-store", False), ("milvus", "vector-store", True),
    ("tidb", "vector-store", True), ("faiss", "vector-store", False), ("qdrant", "vector-store", False), ("vllm", "inference-serving", False),
    ("ollama", "inference-serving", False), ("llamacpp", "inference-serving", False), ("llama.cpp", "inference-serving", False),
    ("sglang", "inference-serving", False), ("tensorrt", "inference-serving", False), ("triton", "inference-serving", False),
    ("onnx", "inference-serving", False), ("cuda", "gpu-orchestration", False), ("ascend", "gpu-orchestration", True),
    ("cann", "gpu-orchestration", True), ("mindspore", "gpu-orchestration", True), ("paddle", "gpu-orchestration", True),
    ("paddlepaddle", "gpu-orchestration", True), ("npu", "gpu-orchestration", True), ("peft", "fine-tuning", False), ("lora", "fine-tuning", False),
    ("qlora", "fine-tuning", False), ("rlhf", "fine-tuning", False), ("sft", "fine-tuning", False), ("axolotl", "fine-tuning", False),
    ("stable diffusion", "multimodal", False), ("diffusion", "multimodal", False), ("comfyui", "multimodal", False),
    ("midjourney", "multimodal", False), ("dall-e", "multimodal", False), ("whisper", "multimodal", False), ("tts", "multimodal", False),
    ("text-to-video", "multimodal", False), ("sagemaker", "ml-platform", False), ("vertex ai", "ml-platform", False),
    ("azure ml", "ml-platform", False), ("bedrock", "ml-platform", False), ("pai", "ml-platform", True), ("modelarts", "ml-platform", True),
)

#: pattern (between word boundaries, case-blind), correction, explanation
# Patterns, corrections and explanations of issues.
SPELLING = (
    (r"responsable", "responsible", "Misspelling of 'responsible'"),
    (r"responcible", "responsible", "Misspelling of 'responsible'"),
    (r"reponsible", "responsible", "Misspelling of 'responsible'"),
    (r"acheive(d|ments?|s)?", "achieve$1", "Misspelling of 'achieve'"),
    (r"achiev(d)", "achieved", "Misspelling of 'achieved'"),
    (r"managment", "management", "Misspelling of 'management'"),
    (r"managmenet", "management", "Misspelling of 'management'"),
    (r"mangement", "management", "Misspelling of 'management'"),
    (r"experiance", "experience", "Misspelling of 'experience'"),
    (r"exprience", "experience", "Misspelling of 'experience'"),
    (r"experinece", "experience", "Misspelling of 'experience'"),
    (r"experence", "experience", "Misspelling of 'experience'"),
    (r"colledge", "college", "Misspelling of 'college'"),
    (r"collage", "college", "Misspelling of 'college' (collage = art form)"),
    (r"curriculam", "curriculum", "Misspelling of 'curriculum'"),
    (r"curiculum", "curriculum", "Misspelling of 'curriculum'"),
    (r"curricullum", "curriculum", "Misspelling of 'curriculum'"),
    (r"impelement(ed|s|ing|ation)?", "implement$1", "Misspelling of 'implement'"),
    (r"impliment(ed|s|ing|ation)?", "implement$1", "Misspelling of 'implement'"),
    (r"implmentation", "implementation", "Misspelling of 'implementation'"),
    (r"devloper(s)?", "developer$1", "Misspelling of 'developer'"),
    (r"devleoper(s)?", "developer$1", "Misspelling of 'developer'"),
    (r"devoelper(s)?", "developer$1", "Misspelling of 'developer'"),
    (r"progamming", "programming", "Misspelling of 'programming'"),
    (r"programing", "programming", "Misspelling of 'programming' (double m)"),
    (r"proggraming", "programming", "Misspelling of 'programming'"),
    (r"technolgy", "technology", "Misspelling of 'technology'"),
    (r"technoloy", "technology", "Misspelling of 'technology'"),
    (r"tecnology", "technology", "Misspelling of 'technology'"),
    (r"succesful(ly)?", "successful$1", "Misspelling of 'successful'"),
    (r"successfull(y)?", "successful$1", "Misspelling of 'successful' (one l)"),
    (r"succesfull(y)?", "successful$1", "Misspelling of 'successful'"),
    (r"certifcate(s)?", "certificate$1", "Misspelling of 'certificate'"),
    (r"certifiacte(s)?", "certificate$1", "Misspelling of 'certificate'"),
    (r"freindly", "friendly", "Misspelling of 'friendly'"),
    (r"enviroment(s)?", "environment$1", "Misspelling of 'environment'"),
    (r"envirnoment(s)?", "environment$1", "Misspelling of 'environment'"),
    (r"environemnt(s)?", "environment$1", "Misspelling of 'environment'"),
    (r"seperate(d|ly|s)?", "separate$1", "Misspelling of 'separate'"),
    (r"definately", "definitely", "Misspelling of 'definitely'"),
    (r"definatly", "definitely", "Misspelling of 'definitely'"),
    (r"defintely", "definitely", "Misspelling of 'definitely'"),
    (r"untill", "until", "Misspelling of 'until'"),
    (r"grammer", "grammar", "Misspelling of 'grammar'"),
    (r"langauge(s)?", "language$1", "Misspelling of 'language'"),
    (r"langugage(s)?", "language$1", "Misspelling of 'language'"),
    (r"data base(s)?", "database$1", "Use 'database' as a single word"),
    (r"softwear", "software", "Misspelling of 'software'"),
    (r"softaware", "software", "Misspelling of 'software'"),
    (r"artifical", "artificial", "Misspelling of 'artificial'"),
    (r"inteligence", "intelligence", "Misspelling of 'intelligence'"),
    (r"intelligance", "intelligence", "Misspelling of 'intelligence'"),
    (r"algorthm(s)?", "algorithm$1", "Misspelling of 'algorithm'"),
    (r"algorithim(s)?", "algorithm$1", "Misspelling of 'algorithm'"),
    (r"algorithim(s)?", "algorithm$1", "Misspelling of 'algorithm'"),
    (r"fronted", "frontend", "Misspelling of 'frontend'"),
    (r"backned", "backend", "Misspelling of 'backend'"),
    (r"flatform", "platform", "Misspelling of 'platform'"),
    (r"platfrom", "platform", "Misspelling of 'platform'"),
    (r"intership(s)?", "internship$1", "Misspelling of 'internship'"),
    (r"internhsip(s)?", "internship$1", "Misspelling of 'internship'"),
    (r"profecient", "proficient", "Misspelling of 'proficient'"),
    (r"proficent", "proficient", "Misspelling of 'proficient'"),
    (r"excelent", "excellent", "Misspelling of 'excellent'"),
    (r"excellant", "excellent", "Misspelling of 'excellent'"),
    (r"leaded", "led", "Past tense of 'lead' is 'led', not 'leaded'"),
    (r"opportuniy", "opportunity", "Misspelling of 'opportunity'"),
    (r"oppertunity", "opportunity", "Misspelling of 'opportunity'"),
    (r"opprotunity", "opportunity", "Misspelling of 'opportunity'"),
    (r"organisation", "organization", "Use American English 'organization' for global ATS"),
    (r"analysed", "analyzed", "Use American English 'analyzed' for global ATS"),
    (r"optimised", "optimized", "Use American English 'optimized' for global ATS"),
    (r"collabration", "collaboration", "Misspelling of 'collaboration'"),
    (r"comunication", "communication", "Misspelling of 'communication'"),
    (r"communiation", "communication", "Misspelling of 'communication'"),
    (r"communcation", "communication", "Misspelling of 'communication'"),
    (r"accomplisment(s)?", "accomplishment$1", "Misspelling of 'accomplishment'"),
    (r"reccomend(ed|ation|ations)?", "recommend$1", "Misspelling of 'recommend'"),
    (r"recommandation(s)?", "recommendation$1", "Misspelling of 'recommendation'"),
    (r"maintainance", "maintenance", "Misspelling of 'maintenance'"),
    (r"maintenence", "maintenance", "Misspelling of 'maintenance'"),
    (r"performence", "performance", "Misspelling of 'performance'"),
    (r"perfomance", "performance", "Misspelling of 'performance'"),
    (r"devolopment", "development", "Misspelling of 'development'"),
    (r"devlopment", "development", "Misspelling of 'development'"),
    (r"developement", "development", "Misspelling of 'development'"),
    (r"relavent", "relevant", "Misspelling of 'relevant'"),
    (r"compatiable", "compatible", "Misspelling of 'compatible'"),
    (r"compitable", "compatible", "Misspelling of 'compatible'"),
    (r"knowledege", "knowledge", "Misspelling of 'knowledge'"),
    (r"knoweldge", "knowledge", "Misspelling of 'knowledge'"),
    (r"achivement(s)?", "achievement$1", "Misspelling of 'achievement'"),
    (r"architechture", "architecture", "Misspelling of 'architecture'"),
    (r"architecutre", "architecture", "Misspelling of 'architecture'"),
    (r"apllication(s)?", "application$1", "Misspelling of 'application'"),
    (r"applicaiton(s)?", "application$1", "Misspelling of 'application'"),
    (r"framwork(s)?", "framework$1", "Misspelling of 'framework'"),
    (r"freamwork(s)?", "framework$1", "Misspelling of 'framework'"),
    (r"deploed", "deployed", "Misspelling of 'deployed'"),
    (r"deploied", "deployed", "Misspelling of 'deployed'"),
    (r"optimzation", "optimization", "Misspelling of 'optimization'"),
    (r"optimizaiton", "optimization", "Misspelling of 'optimization'"),
    (r"infrastruture", "infrastructure", "Misspelling of 'infrastructure'"),
    (r"infrastucture", "infrastructure", "Misspelling of 'infrastructure'"),
    (r"authenication", "authentication", "Misspelling of 'authentication'"),
    (r"authentiation", "authentication", "Misspelling of 'authentication'"),
    (r"authentacation", "authentication", "Misspelling of 'authentication'"),
    (r"synchronus", "synchronous", "Misspelling of 'synchronous'"),
    (r"asynchronus", "asynchronous", "Misspelling of 'asynchronous'"),
    (r"scalabilty", "scalability", "Misspelling of 'scalability'"),
    (r"scalablity", "scalability", "Misspelling of 'scalability'"),
    (r"conculsion", "conclusion", "Misspelling of 'conclusion'"),
    (r"enginer(ing)?", "engineer$1", "Misspelling of 'engineer'"),
    (r"reciever?", "receiver", "Misspelling of 'receiver'"),
    (r"recieve(d|s|r)?", "receive$1", "Misspelling of 'receive' (i before e)"),
    (r"occured", "occurred", "Misspelling of 'occurred' (double r)"),
    (r"occurence(s)?", "occurrence$1", "Misspelling of 'occurrence'"),
    (r"beggining", "beginning", "Misspelling of 'beginning'"),
    (r"begining", "beginning", "Misspelling of 'beginning'"),
    (r"effecient(ly)?", "efficient$1", "Misspelling of 'efficient'"),
    (r"efficent(ly)?", "efficient$1", "Misspelling of 'efficient'"),
    (r"liason", "liaison", "Misspelling of 'liaison'"),
    (r"garantee", "guarantee", "Misspelling of 'guarantee'"),
    (r"neccessary", "necessary", "Misspelling of 'necessary'"),
    (r"neccesary", "necessary", "Misspelling of 'necessary'"),
    (r"necesary", "necessary", "Misspelling of 'necessary'"),
    (r"immediatly", "immediately", "Misspelling of 'immediately'"),
    (r"immidiatly", "immediately", "Misspelling of 'immediately'"),
    (r"possesion", "possession", "Misspelling of 'possession'"),
    (r"privelege(d|s)?", "privilege$1", "Misspelling of 'privilege'"),
    (r"accesible", "accessible", "Misspelling of 'accessible'"),
    (r"accessable", "accessible", "Misspelling of 'accessible'"),
    (r"convienient", "convenient", "Misspelling of 'convenient'"),
    (r"conveniant", "convenient", "Misspelling of 'convenient'"),
    (r"analyis", "analysis", "Misspelling of 'analysis'"),
    (r"analisis", "analysis", "Misspelling of 'analysis'"),
    (r"methodolgy", "methodology", "Misspelling of 'methodology'"),
    (r"integation", "integration", "Misspelling of 'integration'"),
    (r"intergration", "integration", "Misspelling of 'integration'"),
    (r"responisbility", "responsibility", "Misspelling of 'responsibility'"),
    (r"responsibilty", "responsibility", "Misspelling of 'responsibility'"),
    (r"distriubted", "distributed", "Misspelling of 'distributed'"),
    (r"distrbuted", "distributed", "Misspelling of 'distributed'"),
    (r"continerized", "containerized", "Misspelling of 'containerized'"),
    (r"contianerized", "containerized", "Misspelling of 'containerized'"),
    (r"microservies", "microservices", "Misspelling of 'microservices'"),
    (r"micorservices", "microservices", "Misspelling of 'microservices'"),
    (r"repository(s)", "repositories", "Plural of 'repository' is 'repositories'"),
    (r"reposiotry", "repository", "Misspelling of 'repository'"),
    (r"documenation", "documentation", "Misspelling of 'documentation'"),
    (r"documention", "documentation", "Misspelling of 'documentation'"),
    (r"visualisation", "visualization", "Use American English 'visualization'"),
    (r"visualzation", "visualization", "Misspelling of 'visualization'"),
    (r"siginificant(ly)?", "significant$1", "Misspelling of 'significant'"),
    (r"signifcant(ly)?", "significant$1", "Misspelling of 'significant'"),
    (r"resposive", "responsive", "Misspelling of 'responsive'"),
    (r"responsve", "responsive", "Misspelling of 'responsive'"),
    (r"colabaration", "collaboration", "Misspelling of 'collaboration'"),
    (r"dependancy", "dependency", "Misspelling of 'dependency'"),
    (r"dependecy", "dependency", "Misspelling of 'dependency'"),
    (r"functionallity", "functionality", "Misspelling of 'functionality'"),
    (r"fuctionality", "functionality", "Misspelling of 'functionality'"),
    (r"refernce(s)?", "reference$1", "Misspelling of 'reference'"),
    (r"referance(s)?", "reference$1", "Misspelling of 'reference'"),
    (r"imporve(d|s|ment)?", "improve$1", "Misspelling of 'improve'"),
    (r"passed out in (\d{4})", "graduated in $1", "'Passed out' is Indian-English colloquialism; use 'graduated in'"),
    (r"carrier objective", "Career Objective", "'Carrier' means transport; use 'Career'"),
    (r"career objecitve", "Career Objective", "Misspelling of 'objective'"),
    (r"career objectve", "Career Objective", "Misspelling of 'objective'"),
    (r"(?-i:myself\s+([A-Z][a-z]+))", "I am $1", "Avoid 'Myself [Name]'; state name directly"),
    (r"i hereby declare that", "(Remove declaration)", "Outdated declaration wastes resume space and triggers ATS anti-pattern"),
    (r"here by declare", "(Remove declaration)", "Outdated declaration wastes space"),
    (r"under went", "underwent", "'Underwent' is a single word"),
    (r"familiar with using", "proficient in", "Wordy: replace with 'proficient in'"),
    (r"knowledge on", "knowledge of", "Incorrect preposition: use 'knowledge of'"),
    (r"knowledge in", "knowledge of", "Incorrect preposition: use 'knowledge of'"),
    (r"have hands on experience", "hands-on experience in", "Missing hyphens; 'hands-on' is hyphenated"),
    (r"hands on experience", "hands-on experience", "'Hands-on' should be hyphenated"),
    (r"real time", "real-time", "'Real-time' should be hyphenated when used as adjective"),
    (r"full stack", "full-stack", "'Full-stack' should be hyphenated"),
    (r"cross platform", "cross-platform", "'Cross-platform' should be hyphenated"),
    (r"open source", "open-source", "'Open-source' should be hyphenated when used as adjective"),
    (r"well versed", "well-versed", "'Well-versed' should be hyphenated"),
    (r"co ordinator", "coordinator", "'Coordinator' is a single word"),
    (r"web site", "website", "'Website' is a single word"),
    (r"looking for an opportunity", "(Remove — filler)", "Filler phrase: recruiters don't need this"),
    (r"seeking a challenging position", "(Remove — filler)", "Cliché objective statement; replace with specific role target"),
    (r"i am a (hard|dedicated)", "(Remove — filler)", "Subjective self-assessment; show evidence instead"),
)

#: pattern (between word boundaries, case-blind), correction, explanation, severity
GRAMMAR = (
    (r"(?:I|we)\s+has", "I have", "Subject-verb disagreement: use 'have' with 'I/we'", "critical"),
    (r"(?:he|she|it)\s+have", "has", "Subject-verb disagreement: use 'has' with singular third person", "critical"),
    (r"they\s+has", "they have", "Subject-verb disagreement: 'they' requires 'have'", "critical"),
    (r"was\s+develop(ing|ed)?", "developed", "Passive/weak verb: use active verb 'Developed'", "major"),
    (r"have\s+did", "have done", "Incorrect past participle: 'have done'", "critical"),
    (r"have\s+went", "have gone", "Incorrect past participle: 'have gone'", "critical"),
    (r"have\s+ran", "have run", "Incorrect past participle: 'have run'", "major"),
    (r"is\s+create", "creates / created", "Grammatical error: use 'creates' or 'created'", "major"),
    (r"experience\s+in\s+build", "experience in building", "Use gerund 'building' after preposition 'in'", "major"),
    (r"responsible\s+to\s+(build|manage|develop|create|design|implement|handle)", "responsible for $1ing", "Preposition error: 'responsible for [verb]-ing'", "major"),
    (r"expertise\s+on", "expertise in", "Preposition error: use 'expertise in'", "minor"),
    (r"good\s+at", "proficient in", "Informal phrasing: use 'proficient in' on resumes", "minor"),
    (r"capable\s+to", "capable of", "Preposition error: 'capable of [verb]-ing'", "major"),
    (r"worked\s+as\s+a\s+intern", "worked as an intern", "Article error: use 'an' before vowel sounds", "major"),
    (r"as\s+a\s+engineer", "as an engineer", "Article error: use 'an' before 'engineer'", "major"),
    (r"as\s+a\s+analyst", "as an analyst", "Article error: use 'an' before 'analyst'", "major"),
    (r"as\s+a\s+intern", "as an intern", "Article error: use 'an' before 'intern'", "major"),
    (r"(\w{3,})\s+\1", "$1", "Accidental word repetition", "minor"),
    (r"have\s+a\s+good\s+knowledge", "have strong knowledge of", "'Knowledge' is uncountable: 'strong knowledge of'", "minor"),
    (r"many\s+informations?", "much information", "'Information' is uncountable", "major"),
    (r"many\s+softwares?", "many software tools", "'Software' is uncountable; use 'software tools'", "major"),
    (r"softwares", "software tools", "'Software' is uncountable; avoid 'softwares'", "major"),
)

#: pattern, correction, explanation
PUNCTUATION = (
    (r"(?i)([a-z0-9]),([a-z0-9])", "$1, $2", "Missing space after comma"),
    (r"([a-z0-9])\.([A-Z])", "$1. $2", "Missing space after period between sentences"),
    (r",{2,}", ",", "Duplicate comma"),
    (r"\.{2,}(?!\.)", ".", "Duplicate period"),
    (r"\s+([,.;:?!])", "$1", "Space before punctuation mark"),
    (r"([.!?])\s{2,}([A-Z])", "$1 $2", "Multiple spaces between sentences"),
    (r"\s{3,}", " ", "Excessive whitespace (3+ spaces)"),
    (r"(?i)([a-z]);([a-z])", "$1; $2", "Missing space after semicolon"),
    (r"(?i)([a-z]):([a-z])", "$1: $2", "Missing space after colon"),
)

#: id, least and greatest score, label
BANDS = (
    ("90-100", 90, 100, "Exceptional"), ("80-90", 80, 89, "High Match"), ("70-80", 70, 79, "Good / Polish"), ("60-70", 60, 69, "Moderate"),
    ("50-60", 50, 59, "Basic Foundation"), ("40-50", 40, 49, "Significant Gaps"), ("30-40", 30, 39, "Low Fit"), ("20-30", 20, 29, "Minimal"),
    ("10-20", 10, 19, "Very Weak"), ("below-10", 0, 9, "Unsuitable"),
)

#: id, label, whether required
SECTIONS = (
    ("contact", "Contact details", True), ("skills", "Skills & Technologies", True), ("projects", "Projects", True), ("experience", "Experience / Internships", True),
    ("summary", "Professional Summary", False), ("education", "Education (Optional)", False), ("certifications", "Certifications (Optional)", False),
    ("achievements", "Achievements & Awards (Optional)", False),
)

#: section and the words of its headers, in order of precedence
HEADERS = (
    ("summary", r"summary|profile|objective|about\s+me|overview"),
    ("skills", r"skills?|skillset|skill-set|technologies|tech\s+stack|competencies|proficiencies|languages\s*(?:&|and)\s*frameworks|tools\s*(?:&|and)\s*technologies"),
    ("experience", r"experience|employment|internships?|work\s+history|job\s+history|training|work\s+experience"),
    ("education", r"education|qualifications?|background|academics|degrees?"),
    ("projects", r"projects?|project\s+work|project\s+details|project\s+experience|initiatives"),
    ("certifications", r"certifications?|certificates?|licenses?|accreditations?|courses|trainings?\s*(?:&|and)\s*certifications?"),
    ("achievements", r"achievements?|awards?|honou?rs|accomplishments|extra[- ]?curricular|co[- ]?curricular|coding\s+profiles|hackathons?|publications?"),
)
PROOF = r"npm install|pip install|pypi\.org|npmjs\.com|patent|research paper|ijcrt|ieee|springer|published in|hackathon|leetcode|codeforces|kaggle|1st prize|2nd prize|3rd prize"
QUANTIFIED = r"(\d+(\.\d+)?\s?%|\$\s?\d|₹\s?\d|\b\d{2,}\+?\b|\b\d+(\.\d+)?\s?(x|k|m|bn|hrs?|hours?|days?|weeks?|months?|users?|requests?|records?|ms|sec|seconds?|gb|tb|qps|rps)\b)"
PAST = (
    "developed|built|designed|implemented|created|deployed|managed|led|improved|optimized|reduced|increased|automated|integrated|launched|tested|analyzed|configured|"
    "streamlined|established|delivered|engineered|maintained|architected|migrated|refactored|resolved|scaled|shipped|spearheaded|achieved|coordinated|collaborated"
)
PRESENT = (
    "develop|build|design|implement|create|deploy|manage|lead|improve|optimize|reduce|increase|automate|integrate|launch|test|analyze|configure|streamline|establish|"
    "deliver|engineer|maintain|architect|migrate|refactor|resolve|scale|ship|spearhead|achieve|coordinate|collaborate|developing|building|designing|implementing|"
    "creating|deploying|managing|leading"
)

#: words that choose a track, and what it recommends
TRACKS = (
    (("react", "frontend", "html", "css", "javascript", "vue"), ("TypeScript", "Next.js", "Tailwind CSS", "Zustand", "Playwright", "Docker")),
    (("python", "machine learning", "data science", "django", "fastapi"), ("FastAPI", "PostgreSQL", "Redis", "Docker", "Pytest", "Vector Search (FAISS)")),
    (("java", "spring"), ("Spring Boot", "Microservices", "PostgreSQL", "Docker", "JUnit", "Redis")),
    (("flutter", "react native", "android", "ios", "kotlin", "swift"), ("State Management", "Firebase", "Offline Sync", "CI/CD Pipeline", "TypeScript")),
    ((), ("PostgreSQL", "Docker", "REST API Design", "Unit Testing", "Git")),
)
TOOL_LABELS = (
    ("foundation-model", "LLMs"), ("agent-framework", "Agent/RAG"), ("vector-store", "Vector DBs"), ("inference-serving", "Local Inference"),
    ("gpu-orchestration", "GPU Stacks"), ("fine-tuning", "Fine-Tuning"), ("multimodal", "Multimodal"), ("ml-platform", "ML Platforms"),
)

#: id, title, category, core skills, description
# The preset job descriptions.
JOB_DESCRIPTIONS = (
    ("frontend-react", "Frontend Developer (React / TypeScript)", "Frontend", ("React", "TypeScript", "JavaScript", "HTML", "CSS", "Tailwind CSS", "Next.js", "Redux", "REST API", "Git"), (
        "We are looking for a skilled Frontend Developer proficient in React, TypeScript, modern CSS (Tailwind), and Next.js.\n"
        "Key Responsibilities:\n"
        "- Build responsive, accessible, and high-performance user interfaces.\n"
        "- Integrate RESTful and GraphQL APIs with state management (Redux, React Query, or Zustand).\n"
        "- Implement client-side optimizations, component testing (Jest, React Testing Library), and clean UI architecture.\n"
        "- Collaborate with backend engineers, designers, and product managers."
    )),
    ("backend-node-python", "Backend Software Engineer (Node.js / Python)", "Backend", ("Node.js", "Python", "TypeScript", "PostgreSQL", "MongoDB", "Redis", "Docker", "REST API", "Microservices", "Git"), (
        "Seeking a Backend Software Engineer with solid foundations in Node.js or Python, relational/NoSQL databases, and API development.\n"
        "Key Responsibilities:\n"
        "- Design, develop, and maintain high-throughput backend services and microservices.\n"
        "- Design database schemas, optimize SQL queries, and implement Redis caching.\n"
        "- Build secure authentication (JWT, OAuth), rate limiting, and event-driven architectures.\n"
        "- Containerize services with Docker and participate in code reviews."
    )),
    ("fullstack-mern", "Full Stack Engineer (MERN / Next.js)", "FullStack", ("React", "Node.js", "TypeScript", "Express", "MongoDB", "PostgreSQL", "Next.js", "Tailwind CSS", "Docker", "Git"), (
        "Looking for a versatile Full Stack Developer comfortable with end-to-end web engineering.\n"
        "Key Responsibilities:\n"
        "- Develop modern full-stack web applications using React, Next.js, Node.js, and PostgreSQL/MongoDB.\n"
        "- Implement server-side rendering, database migrations, and REST/GraphQL APIs.\n"
        "- Ensure test coverage, CI/CD deployment automation, and responsive UI design."
    )),
    ("ai-ml-rag", "AI / ML Engineer (Python / LLM / RAG)", "AI/ML", ("Python", "PyTorch", "LangChain", "LlamaIndex", "Vector Search", "Transformers", "FastAPI", "Docker", "Git"), (
        "Seeking an AI / ML Engineer specializing in Generative AI, Retrieval-Augmented Generation (RAG), and model deployment.\n"
        "Key Responsibilities:\n"
        "- Build and evaluate RAG pipelines using vector databases (Pinecone, Chroma, Qdrant, FAISS) and embedding models.\n"
        "- Fine-tune or prompt-engineer open-source and frontier LLMs (Llama, Mistral, Qwen, Gemini).\n"
        "- Build fast microservice APIs with FastAPI and containerize AI workflows with Docker."
    )),
    ("devops-cloud", "DevOps & Cloud Engineer (AWS / Kubernetes)", "DevOps", ("Kubernetes", "Docker", "AWS", "Terraform", "CI/CD", "GitHub Actions", "Linux", "Prometheus", "Git"), (
        "Looking for a DevOps & Infrastructure Engineer to scale cloud architectures and delivery pipelines.\n"
        "Key Responsibilities:\n"
        "- Maintain Kubernetes clusters, Docker container orchestration, and Infrastructure as Code (Terraform).\n"
        "- Build robust CI/CD deployment pipelines using GitHub Actions or GitLab CI.\n"
        "- Implement cloud security, observability, logging, and metrics (Prometheus, Grafana)."
    )),
    ("data-analyst", "Data Analyst / Analytics Engineer", "Data", ("SQL", "Python", "Pandas", "Power BI", "Tableau", "Data Modeling", "Excel", "Statistics", "Git"), (
        "We are hiring a Data Analyst to translate raw metrics into actionable business intelligence.\n"
        "Key Responsibilities:\n"
        "- Write complex SQL queries, extract datasets, and perform exploratory data analysis using Python (Pandas, NumPy).\n"
        "- Design and maintain interactive dashboards in Power BI or Tableau.\n"
        "- Perform statistical analysis, cohort segmentation, and metric KPI tracking."
    )),
)
