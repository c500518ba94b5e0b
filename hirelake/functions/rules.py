"""Rule values of the job-posting domain. All are fixed values."""

# Patterns of what says nothing about a job title, and abbreviations in titles.
TITLE_NOISE = [
    r"\bremote\b", r"\bhybrid\b", r"\bonsite\b", r"\bon site\b", r"\bwork from home\b", r"\bwfh\b", r"\bfull time\b", r"\bfull-time\b", r"\bpart time\b", r"\bpart-time\b",
    r"\bcontract\b", r"\btemporary\b", r"\bfreelance\b", r"\binternship\b", r"\burgent\b", r"\bimmediate\b", r"\bhiring\b", r"\bapply now\b", r"\bm/f/d\b", r"\bf/m/d\b", r"\bw/m/d\b",
]
TITLE_ALIASES = {"sr": "senior", "jr": "junior", "dev": "developer", "eng": "engineer", "mgr": "manager", "swe": "software engineer", "bi": "business intelligence", "ba": "business analyst", "ml": "machine learning"}

# Seniority levels, the first that matches wins.
SENIORITY = [("Intern", r"\b(intern|trainee)\b"), ("Junior", r"\b(junior|entry level|entry)\b"), ("Senior", r"\b(senior|lead|principal|staff)\b"), ("Manager", r"\b(manager|head|director|vp|chief)\b")]
SENIORITY_BATCH = [("Intern", r"\b(intern|internship|trainee)\b"), ("Junior", r"\b(junior|entry level|entry)\b"), ("Senior", r"\b(senior|lead|principal|staff|expert)\b"), ("Manager", r"\b(manager|head|director|vp|chief|cfo|country manager)\b")]

# What isn't a skill.
SKILL_NOISE = [r"\b\d+\+?\s*(years?|yrs?)\b", r"\bexperience\b", r"\bdegree\b", r"\bbachelor\b", r"\bmaster\b", r"\bphd\b", r"\bability to\b", r"\bresponsible for\b", r"\bsalary\b", r"\bbenefits?\b"]

# Generic titles, levels of skill weights, occupation families by source.
GENERIC_TITLES = ["analyst", "manager", "specialist", "associate", "consultant", "coordinator", "assistant", "technician"]
LEVEL_WEIGHTS = {
    "senior": {"leadership": 1.5, "team management": 1.5, "project management": 1.4, "system design": 1.4, "architecture": 1.4, "mentoring": 1.3, "strategic planning": 1.3, "stakeholder management": 1.3, "risk management": 1.2, "budgeting": 1.2},
    "junior": {"communication": 1.2, "teamwork": 1.2, "problem solving": 1.2, "time management": 1.1},
}
UNKNOWN = "Other / Unknown"
FAMILY_HISTORICAL = {"Data & Analytics": "Technology & Analytics", "IT / Software": "Technology & Analytics", "AI / Machine Learning": "Technology & Analytics", "Finance & Accounting": "Business & Finance", "Human Resources": "Business & Finance", "Legal": "Professional Services", "Sales": "Commercial", "Marketing / Communications": "Commercial", "Customer Service": "Commercial", "Retail / Hospitality": "Commercial", "Healthcare": "Healthcare", "Education / Training": "Education", "Logistics / Supply Chain": "Operations", "Manufacturing / Production": "Operations", "Engineering": "Engineering", UNKNOWN: UNKNOWN}
FAMILY_BATCH = {"Data & Analytics": "Technology & Analytics", "IT / Software": "Technology & Analytics", "Engineering": "Engineering", "Finance & Accounting": "Business & Finance", "Sales": "Commercial", "Marketing / Communications": "Commercial", "Human Resources": "Professional Services", "Legal": "Professional Services", "Customer Service": "Operations", "Logistics / Supply Chain": "Operations", "Manufacturing / Production": "Operations", "Retail / Hospitality": "Commercial", "Healthcare": "Healthcare", "Education / Training": "Education", UNKNOWN: UNKNOWN}

# Countries, states and cities by their spellings.
COUNTRIES = {"us": "United States", "usa": "United States", "united states": "United States", "united states of america": "United States", "uk": "United Kingdom", "united kingdom": "United Kingdom", "england": "United Kingdom", "canada": "Canada", "india": "India", "vietnam": "Vietnam", "viet nam": "Vietnam", "singapore": "Singapore", "australia": "Australia", "germany": "Germany", "france": "France", "netherlands": "Netherlands", "ireland": "Ireland", "philippines": "Philippines", "mexico": "Mexico", "brazil": "Brazil", "japan": "Japan", "china": "China", "malaysia": "Malaysia", "thailand": "Thailand", "indonesia": "Indonesia"}
STATE_CODES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt",
    "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
]
STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
]
LOCATION_NOISE = ["remote", "hybrid", "onsite", "on-site", "on site", "work from home", "wfh", "home based", "anywhere"]
COUNTRIES_BATCH = {
    "vietnam": "Vietnam", "viet nam": "Vietnam", "việt nam": "Vietnam", "united states": "United States", "usa": "United States", "us": "United States", "u.s.": "United States", "america": "United States",
    "united kingdom": "United Kingdom", "uk": "United Kingdom", "u.k.": "United Kingdom", "england": "United Kingdom", "canada": "Canada", "australia": "Australia", "india": "India", "france": "France",
    "germany": "Germany", "china": "China", "japan": "Japan", "south korea": "South Korea", "korea": "South Korea", "singapore": "Singapore", "malaysia": "Malaysia", "thailand": "Thailand",
    "indonesia": "Indonesia", "philippines": "Philippines", "mexico": "Mexico", "brazil": "Brazil", "ireland": "Ireland", "netherlands": "Netherlands",
}
CITIES_BATCH = {"hcm": "Ho Chi Minh", "hcmc": "Ho Chi Minh", "ho chi minh": "Ho Chi Minh", "ho chi minh city": "Ho Chi Minh", "hồ chí minh": "Ho Chi Minh", "hn": "Hanoi", "ha noi": "Hanoi", "hanoi": "Hanoi", "hà nội": "Hanoi", "danang": "Da Nang", "da nang": "Da Nang", "đà nẵng": "Da Nang", "haiphong": "Hai Phong", "hai phong": "Hai Phong", "hải phòng": "Hai Phong"}

# Weights of ranking.
SOURCE_LIMITS = {"historical": 300, "incremental": 50}
SOURCE_WEIGHTS = {"historical": 0.45, "incremental": 0.55}
SKILL_SOURCE_WEIGHTS = {"historical": 0.40, "incremental": 0.60}
KIND_WEIGHTS = {"title": 0.30, "skills": 0.30, "full": 0.40}
RERANK = {"semantic": 0.45, "title": 0.20, "skills": 0.25, "location": 0.10}

# What the incremental source's titles lose, in this order, and what is stripped from their ends.
BATCH_TITLE_NOISE = [
    r"\bhiring week\b", r"\bhot job\b", r"\burgent hiring\b", r"\bimmediate hiring\b", r"\btalent pool\b", r"\bvietnamese only\b", r"\boutsourcing\b",
    r"\bin hcmc office\b", r"\bin hanoi office\b", r"\bhcmc office\b", r"\bhanoi office\b", r"\bhcm office\b", r"\bhcm\b", r"\bhn\b",
    r"\(vietnamese only\)", r"\(outsourcing\)", r"\(contract\)", r"\(talent pool\)", r"\(non-technical background required\)", r"\(based in cambodia\)",
]
TITLE_ENDS = " -_|/.,;:"

# Spellings of skills in the incremental source, matched as they are written.
SKILL_SPELLINGS = {
    "Ai": "AI", "ai": "AI", "Power Bi": "Power BI", "power bi": "Power BI", "Ms Excel": "Microsoft Excel", "MS Excel": "Microsoft Excel", "Excel": "Microsoft Excel", "Sql": "SQL", "sql": "SQL",
    "Javascript": "JavaScript", "javascript": "JavaScript", "Typescript": "TypeScript", "typescript": "TypeScript", "Nodejs": "Node.js", "NodeJS": "Node.js", "nodejs": "Node.js",
    "Reactjs": "React", "ReactJS": "React", "reactjs": "React", "Vuejs": "Vue.js", "VueJS": "Vue.js", "Devops": "DevOps", "devops": "DevOps", "Apis": "APIs", "Restful Apis": "RESTful APIs",
    "Aws": "AWS", "Aws Cloud": "AWS Cloud", "Pytorch": "PyTorch", "Tensorflow": "TensorFlow", "Nlp": "NLP", "LlM": "LLM", "LLM": "LLM", "Crm": "CRM", "CRM": "CRM", "Jira": "JIRA", "jira": "JIRA",
}

# Skills of the incremental source by their lower-cased names.
SKILL_ALIASES_BATCH = {
    "ai": "AI", "powerbi": "Power BI", "power bi": "Power BI", "microsoft power bi": "Power BI", "excel": "Microsoft Excel", "ms excel": "Microsoft Excel", "microsoft excel": "Microsoft Excel",
    "powerpoint": "Microsoft PowerPoint", "ms powerpoint": "Microsoft PowerPoint", "sql": "SQL", "sql server": "SQL Server", "mssql": "SQL Server", "mysql": "MySQL", "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL", "js": "JavaScript", "javascript": "JavaScript", "typescript": "TypeScript", "nodejs": "Node.js", "node js": "Node.js", "node.js": "Node.js", "reactjs": "React",
    "react js": "React", "react.js": "React", "vuejs": "Vue.js", "vue js": "Vue.js", "vue": "Vue.js", "devops": "DevOps", "aws": "AWS", "aws cloud": "AWS Cloud", "azure": "Azure",
    "azure cloud": "Azure Cloud", "restful apis": "RESTful APIs", "apis": "APIs", "api design": "API Design", "pytorch": "PyTorch", "tensorflow": "TensorFlow", "nlp": "NLP", "llm": "LLM",
    "rag": "RAG", "crm": "CRM", "salesforce crm": "Salesforce CRM", "jira": "JIRA", "ifrs": "IFRS", "gaap": "GAAP", "seo": "SEO", "sem": "SEM",
}

# Skills of profiles by their lower-cased names.
PROFILE_ALIASES = {
    "sql": "SQL", "power bi": "Power BI", "powerbi": "Power BI", "excel": "Microsoft Excel", "ms excel": "Microsoft Excel", "python": "Python", "java": "Java", "javascript": "JavaScript",
    "typescript": "TypeScript", "nodejs": "Node.js", "node.js": "Node.js", "reactjs": "React", "react": "React", "machine learning": "Machine Learning", "ml": "Machine Learning",
    "deep learning": "Deep Learning", "nlp": "NLP", "llm": "LLM", "rag": "RAG", "etl": "ETL", "spark": "Spark", "pyspark": "PySpark", "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "mysql": "MySQL", "mongodb": "MongoDB", "docker": "Docker", "kubernetes": "Kubernetes", "aws": "AWS", "azure": "Azure",
}

# Occupation groups of the incremental source, the first that matches wins.
BATCH_GROUPS = [
    ("Data & Analytics", r"\b(data analyst|data analytics|analytics|business intelligence|bi analyst|power bi|tableau|looker|data scientist|machine learning|deep learning|data engineer|analytics engineer|bigquery|databricks|data modeling|data analysis|reporting|data visualization)\b"),
    ("IT / Software", r"\b(software engineer|software developer|backend|frontend|fullstack|full stack|developer|devops|java|python|javascript|typescript|node\.?js|react|vue|angular|\.net|c\+\+|golang|kubernetes|docker|api|apis|microservices|cloud|aws|azure|qa engineer|test automation|solution designer|solution architect|product owner|security engineer|soc|cyber security|information security|ai engineer|nlp|llm|rag|langchain|langgraph|generative ai)\b"),
    ("Finance & Accounting", r"\b(finance|financial|accountant|accounting|audit|auditor|chief accountant|cfo|ifrs|gaap|tax|payroll|investment analyst|banking|credit card|wealth banking|budgeting|financial management|cash flow|bancassurance)\b"),
    ("Sales", r"\b(sales|account executive|account manager|business development|key account|inside sales|country sales|sales manager|sales executive|relationship manager|seller management|client engagement|crm|salesforce|negotiation|b2b sales)\b"),
    ("Marketing / Communications", r"\b(marketing|digital marketing|social media|content|seo|sem|google analytics|facebook ads|brand|communication|communications|user acquisition|growth|performance marketing|media relations|influencer|ad tech|campaign|meta ads)\b"),
    ("Human Resources", r"\b(hr|human resources|talent acquisition|recruitment|recruiter|learning partner|payroll service|hrbp|employee relations|organization development|learning development|hr operations|workforce planning|benefits|employee engagement)\b"),
    ("Healthcare", r"\b(nurse|registered nurse|medical|clinical|healthcare|pharma|pharmaceutical|lab|regulatory affairs|quality assurance in pharma|patient|therapy|hospital)\b"),
    ("Education / Training", r"\b(teacher|trainer|training|education|instructor|learning|teaching|professor|tutor|instructional design|curriculum)\b"),
    ("Logistics / Supply Chain", r"\b(logistics|supply chain|warehouse|transportation|procurement|purchasing|inventory|shipping|linehaul|spx|scommerce|material coordinator|import export|customs|vendor selection|mro sourcing)\b"),
    ("Customer Service", r"\b(customer service|customer support|customer success|client support|field service|service engineer|support engineer|customer onboarding|customer retention)\b"),
    ("Engineering", r"\b(engineer|mechanical|electrical|civil|hardware|cad|drafter|quality engineer|process engineer|manufacturing engineer|functional safety|fusa|test engineer|low voltage|interior module|pcb|schematic|simulation|autocad|catia|tensorRT|cuda)\b"),
    ("Legal", r"\b(legal|law|lawyer|attorney|compliance|ip associate|regulatory compliance|trade compliance|contractual|counsel|data protection|governance|grc|risk management|audit compliance)\b"),
    ("Retail / Hospitality", r"\b(retail|hospitality|hotel|resort|housekeeping|restaurant|cashier|front office|guest relations|rooms|concierge|cage cashier|barista|store manager|store associate)\b"),
    ("Manufacturing / Production", r"\b(production|manufacturing|factory|smt|equipment maintenance|machine|quality control|qc staff|pqa|gmp|visual inspection|equipment installation|calibration|process control)\b"),
]
