"""Occupation groups: their keywords, title patterns and the canonical titles that they stand for. All are fixed values."""

# Words in a cleaned title that speak for a group of the historical source, anywhere in the title.
TITLE_KEYWORDS = {
    "Data & Analytics": ["data analyst", "business intelligence", "bi analyst", "reporting analyst", "data scientist", "analytics engineer", "data engineer"],
    "IT / Software": ["software engineer", "software developer", "developer", "backend", "front end", "frontend", "full stack", "devops", "programmer", "systems administrator"],
    "Finance & Accounting": ["accountant", "financial analyst", "finance analyst", "auditor", "bookkeeper", "controller", "payroll", "tax specialist"],
    "Sales": ["sales representative", "sales executive", "account executive", "sales consultant", "business development", "sales manager"],
    "Marketing / Communications": ["marketing specialist", "marketing manager", "seo", "content manager", "social media", "brand manager", "communications"],
    "Human Resources": ["human resources", "hr specialist", "hr manager", "recruiter", "talent acquisition", "people operations"],
    "Healthcare": ["registered nurse", "nurse", "medical assistant", "physician", "pharmacist", "therapist", "clinical", "healthcare"],
    "Education / Training": ["teacher", "instructor", "professor", "tutor", "teaching assistant", "trainer"],
    "Logistics / Supply Chain": ["warehouse", "logistics", "supply chain", "inventory", "procurement", "buyer", "shipping"],
    "Customer Service": ["customer service", "customer support", "call center", "client support", "guest service"],
    "Engineering": ["mechanical engineer", "electrical engineer", "civil engineer", "manufacturing engineer", "process engineer", "quality engineer"],
    "Legal": ["legal assistant", "paralegal", "attorney", "lawyer", "legal counsel", "compliance officer"],
    "Retail / Hospitality": ["cashier", "store associate", "retail associate", "restaurant", "server", "barista", "hotel", "hospitality"],
    "Manufacturing / Production": ["production worker", "machine operator", "assembler", "manufacturing", "production supervisor"],
}

# Words in the skills that speak for a group of the historical source, anywhere in the joined skills.
SKILL_KEYWORDS = {
    "Data & Analytics": ["sql", "power bi", "tableau", "python", "dashboard", "data visualization", "statistics", "data modeling", "excel"],
    "IT / Software": ["javascript", "java", "react", "node.js", "c++", "c#", ".net", "docker", "kubernetes", "api", "git"],
    "Finance & Accounting": ["gaap", "ifrs", "financial reporting", "budgeting", "forecasting", "accounts payable", "accounts receivable", "tax", "audit"],
    "Sales": ["crm", "salesforce", "lead generation", "cold calling", "negotiation", "account management", "b2b", "b2c"],
    "Marketing / Communications": ["seo", "sem", "google analytics", "content marketing", "social media", "campaign management", "email marketing"],
    "Human Resources": ["recruitment", "talent acquisition", "payroll", "hris", "employee relations", "onboarding"],
    "Healthcare": ["patient care", "cpr", "bls", "emr", "hipaa", "medication administration", "clinical care"],
    "Education / Training": ["lesson planning", "curriculum", "teaching", "classroom management", "training", "instruction"],
    "Logistics / Supply Chain": ["inventory management", "warehouse management", "wms", "shipping", "procurement", "forklift", "supply chain"],
    "Customer Service": ["customer service", "customer support", "call center", "client relations", "problem solving"],
    "Engineering": ["autocad", "solidworks", "engineering", "quality control", "manufacturing process", "cad"],
    "Legal": ["legal research", "contract management", "compliance", "litigation", "paralegal"],
    "Retail / Hospitality": ["cash handling", "pos", "merchandising", "food safety", "guest service", "hospitality"],
    "Manufacturing / Production": ["machine operation", "assembly", "production", "quality inspection", "lean manufacturing", "osha"],
}

# Patterns of a canonical title that settle a group of the historical source.
GROUP_PATTERNS = {
    "AI / Machine Learning": [r"\bai engineer\b", r"\bmachine learning engineer\b", r"\bml engineer\b", r"\bdeep learning engineer\b", r"\bcomputer vision engineer\b", r"\bnlp engineer\b", r"\bprompt engineer\b", r"\bmlops engineer\b", r"\bai research scientist\b"],
    "Data & Analytics": [r"\bdata analyst\b", r"\bbusiness intelligence analyst\b", r"\breporting analyst\b", r"\bdata scientist\b", r"\bdata engineer\b", r"\banalytics engineer\b"],
    "IT / Software": [r"\bsoftware engineer\b", r"\bsoftware developer\b", r"\bbackend developer\b", r"\bfrontend developer\b", r"\bfull stack developer\b", r"\bdevops engineer\b", r"\bprogrammer\b", r"\bsystems administrator\b"],
    "Finance & Accounting": [r"\bfinancial analyst\b", r"\baccountant\b", r"\bauditor\b", r"\bbookkeeper\b", r"\bcontroller\b", r"\bpayroll specialist\b", r"\btax specialist\b"],
    "Sales": [r"\bsales representative\b", r"\bsales executive\b", r"\baccount executive\b", r"\bsales consultant\b", r"\bbusiness development representative\b", r"\bsales manager\b"],
    "Marketing / Communications": [r"\bmarketing specialist\b", r"\bmarketing manager\b", r"\bseo specialist\b", r"\bcontent manager\b", r"\bsocial media specialist\b", r"\bbrand manager\b", r"\bcommunications specialist\b"],
    "Human Resources": [r"\bhuman resources specialist\b", r"\bhuman resources manager\b", r"\brecruiter\b", r"\btalent acquisition specialist\b", r"\bpeople operations specialist\b"],
    "Healthcare": [r"\bregistered nurse\b", r"\bnurse\b", r"\bmedical assistant\b", r"\bphysician\b", r"\bpharmacist\b", r"\btherapist\b", r"\bclinical specialist\b"],
    "Education / Training": [r"\bteacher\b", r"\binstructor\b", r"\bprofessor\b", r"\btutor\b", r"\bteaching assistant\b", r"\btrainer\b"],
    "Logistics / Supply Chain": [r"\bwarehouse associate\b", r"\blogistics specialist\b", r"\bsupply chain specialist\b", r"\binventory specialist\b", r"\bprocurement specialist\b", r"\bbuyer\b", r"\bshipping specialist\b"],
    "Customer Service": [r"\bcustomer service representative\b", r"\bcustomer support specialist\b", r"\bcall center representative\b", r"\bclient support specialist\b", r"\bguest service representative\b"],
    "Engineering": [r"\bmechanical engineer\b", r"\belectrical engineer\b", r"\bcivil engineer\b", r"\bmanufacturing engineer\b", r"\bprocess engineer\b", r"\bquality engineer\b"],
    "Legal": [r"\blegal assistant\b", r"\bparalegal\b", r"\battorney\b", r"\blawyer\b", r"\blegal counsel\b", r"\bcompliance officer\b"],
    "Retail / Hospitality": [r"\bcashier\b", r"\bstore associate\b", r"\bretail associate\b", r"\brestaurant staff\b", r"\bserver\b", r"\bbarista\b", r"\bhotel staff\b", r"\bhospitality staff\b"],
    "Manufacturing / Production": [r"\bproduction worker\b", r"\bmachine operator\b", r"\bassembler\b", r"\bmanufacturing worker\b", r"\bproduction supervisor\b"],
}

# Words in the canonical skills that settle a group of the historical source.
GROUP_SKILLS = {
    "AI / Machine Learning": ["machine learning", "deep learning", "tensorflow", "pytorch", "computer vision", "natural language processing", "nlp", "llm", "generative ai", "mlops"],
    "Data & Analytics": ["sql", "power bi", "tableau", "dashboard", "data visualization", "statistics", "data modeling", "microsoft excel"],
    "IT / Software": ["javascript", "java", "react", "node.js", "c++", "c#", ".net", "docker", "kubernetes", "api", "git"],
    "Finance & Accounting": ["gaap", "ifrs", "financial reporting", "budgeting", "forecasting", "accounts payable", "accounts receivable", "profit and loss"],
    "Sales": ["crm", "salesforce", "lead generation", "cold calling", "negotiation", "account management"],
    "Marketing / Communications": ["seo", "sem", "google analytics", "content marketing", "social media", "campaign management", "email marketing"],
    "Human Resources": ["recruitment", "talent acquisition", "payroll", "hris", "employee relations", "onboarding"],
    "Healthcare": ["patient care", "cpr", "basic life support", "electronic medical records", "hipaa", "medication administration", "clinical care"],
    "Education / Training": ["lesson planning", "curriculum", "teaching", "classroom management", "training", "instruction"],
    "Logistics / Supply Chain": ["inventory management", "warehouse management system", "shipping", "procurement", "forklift", "supply chain"],
    "Customer Service": ["customer service", "customer support", "call center", "client relations", "problem solving"],
    "Engineering": ["autocad", "solidworks", "engineering", "quality control", "cad"],
    "Legal": ["legal research", "contract management", "compliance", "litigation", "paralegal"],
    "Retail / Hospitality": ["cash handling", "pos", "merchandising", "food safety", "guest service", "hospitality"],
    "Manufacturing / Production": ["machine operation", "assembly", "production", "quality inspection", "lean manufacturing", "osha"],
}

# Canonical names of skills of the historical source.
SKILL_ALIASES = {
    "powerbi": "Power BI", "power bi": "Power BI", "microsoft power bi": "Power BI", "excel": "Microsoft Excel", "ms excel": "Microsoft Excel", "microsoft excel": "Microsoft Excel",
    "sql server": "SQL Server", "mssql": "SQL Server", "mysql": "MySQL", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "js": "JavaScript", "javascript": "JavaScript",
    "nodejs": "Node.js", "node js": "Node.js", "node.js": "Node.js", "reactjs": "React", "react js": "React", "react.js": "React", "c sharp": "C#", "c#": "C#", "c plus plus": "C++", "c++": "C++",
    "dotnet": ".NET", "dot net": ".NET", ".net": ".NET", "gaap": "GAAP", "ifrs": "IFRS", "p&l": "Profit and Loss", "crm": "CRM", "salesforce": "Salesforce", "seo": "SEO", "sem": "SEM",
    "cpr": "CPR", "bls": "Basic Life Support", "emr": "Electronic Medical Records", "hipaa": "HIPAA", "wms": "Warehouse Management System", "osha": "OSHA",
}

# Per group, patterns of a title with the canonical title and the function group; the first that matches counts. Historical source.
TITLE_PATTERNS = {
    "Data & Analytics": [
        (r"\bdata analyst\b", "Data Analyst", "Analytics"),
        (r"\bbusiness intelligence\b", "Business Intelligence Analyst", "BI"),
        (r"\bbi analyst\b", "Business Intelligence Analyst", "BI"),
        (r"\breporting analyst\b", "Reporting Analyst", "Analytics"),
        (r"\bdata scientist\b", "Data Scientist", "Data Science"),
        (r"\bdata engineer\b", "Data Engineer", "Data Engineering"),
        (r"\banalytics engineer\b", "Analytics Engineer", "Analytics"),
    ],
    "IT / Software": [
        (r"\bsoftware engineer\b", "Software Engineer", "Software Development"),
        (r"\bsoftware developer\b", "Software Developer", "Software Development"),
        (r"\bbackend\b", "Backend Developer", "Software Development"),
        (r"\bfront end\b", "Frontend Developer", "Software Development"),
        (r"\bfrontend\b", "Frontend Developer", "Software Development"),
        (r"\bfull stack\b", "Full Stack Developer", "Software Development"),
        (r"\bdevops\b", "DevOps Engineer", "Infrastructure"),
        (r"\bprogrammer\b", "Programmer", "Software Development"),
        (r"\bsystems administrator\b", "Systems Administrator", "Infrastructure"),
    ],
    "Finance & Accounting": [
        (r"\bfinancial analyst\b", "Financial Analyst", "Finance"),
        (r"\bfinance analyst\b", "Financial Analyst", "Finance"),
        (r"\baccountant\b", "Accountant", "Accounting"),
        (r"\bauditor\b", "Auditor", "Audit"),
        (r"\bbookkeeper\b", "Bookkeeper", "Accounting"),
        (r"\bcontroller\b", "Controller", "Accounting"),
        (r"\bpayroll\b", "Payroll Specialist", "Payroll"),
        (r"\btax\b", "Tax Specialist", "Tax"),
    ],
    "Sales": [
        (r"\bsales representative\b", "Sales Representative", "Sales"),
        (r"\bsales executive\b", "Sales Executive", "Sales"),
        (r"\baccount executive\b", "Account Executive", "Sales"),
        (r"\bsales consultant\b", "Sales Consultant", "Sales"),
        (r"\bbusiness development\b", "Business Development Representative", "Sales"),
        (r"\bsales manager\b", "Sales Manager", "Sales"),
    ],
    "Marketing / Communications": [
        (r"\bmarketing specialist\b", "Marketing Specialist", "Marketing"),
        (r"\bmarketing manager\b", "Marketing Manager", "Marketing"),
        (r"\bseo\b", "SEO Specialist", "Digital Marketing"),
        (r"\bcontent manager\b", "Content Manager", "Content"),
        (r"\bsocial media\b", "Social Media Specialist", "Digital Marketing"),
        (r"\bbrand manager\b", "Brand Manager", "Brand"),
        (r"\bcommunications\b", "Communications Specialist", "Communications"),
    ],
    "Human Resources": [
        (r"\bhuman resources\b", "Human Resources Specialist", "HR"),
        (r"\bhr specialist\b", "Human Resources Specialist", "HR"),
        (r"\bhr manager\b", "Human Resources Manager", "HR"),
        (r"\brecruiter\b", "Recruiter", "Recruitment"),
        (r"\btalent acquisition\b", "Talent Acquisition Specialist", "Recruitment"),
        (r"\bpeople operations\b", "People Operations Specialist", "HR Operations"),
    ],
    "Healthcare": [
        (r"\bregistered nurse\b", "Registered Nurse", "Clinical Care"),
        (r"\bnurse\b", "Nurse", "Clinical Care"),
        (r"\bmedical assistant\b", "Medical Assistant", "Healthcare Support"),
        (r"\bphysician\b", "Physician", "Clinical Care"),
        (r"\bpharmacist\b", "Pharmacist", "Pharmacy"),
        (r"\btherapist\b", "Therapist", "Therapy"),
        (r"\bclinical\b", "Clinical Specialist", "Clinical Care"),
    ],
    "Education / Training": [
        (r"\bteacher\b", "Teacher", "Teaching"),
        (r"\binstructor\b", "Instructor", "Teaching"),
        (r"\bprofessor\b", "Professor", "Higher Education"),
        (r"\btutor\b", "Tutor", "Teaching"),
        (r"\bteaching assistant\b", "Teaching Assistant", "Teaching Support"),
        (r"\btrainer\b", "Trainer", "Training"),
    ],
    "Logistics / Supply Chain": [
        (r"\bwarehouse\b", "Warehouse Associate", "Warehousing"),
        (r"\blogistics\b", "Logistics Specialist", "Logistics"),
        (r"\bsupply chain\b", "Supply Chain Specialist", "Supply Chain"),
        (r"\binventory\b", "Inventory Specialist", "Inventory"),
        (r"\bprocurement\b", "Procurement Specialist", "Procurement"),
        (r"\bbuyer\b", "Buyer", "Procurement"),
        (r"\bshipping\b", "Shipping Specialist", "Logistics"),
    ],
    "Customer Service": [
        (r"\bcustomer service\b", "Customer Service Representative", "Customer Support"),
        (r"\bcustomer support\b", "Customer Support Specialist", "Customer Support"),
        (r"\bcall center\b", "Call Center Representative", "Customer Support"),
        (r"\bclient support\b", "Client Support Specialist", "Customer Support"),
        (r"\bguest service\b", "Guest Service Representative", "Customer Service"),
    ],
    "Engineering": [
        (r"\bmechanical engineer\b", "Mechanical Engineer", "Engineering"),
        (r"\belectrical engineer\b", "Electrical Engineer", "Engineering"),
        (r"\bcivil engineer\b", "Civil Engineer", "Engineering"),
        (r"\bmanufacturing engineer\b", "Manufacturing Engineer", "Manufacturing Engineering"),
        (r"\bprocess engineer\b", "Process Engineer", "Process Engineering"),
        (r"\bquality engineer\b", "Quality Engineer", "Quality Engineering"),
    ],
    "Legal": [
        (r"\blegal assistant\b", "Legal Assistant", "Legal Support"),
        (r"\bparalegal\b", "Paralegal", "Legal Support"),
        (r"\battorney\b", "Attorney", "Legal"),
        (r"\blawyer\b", "Lawyer", "Legal"),
        (r"\blegal counsel\b", "Legal Counsel", "Legal"),
        (r"\bcompliance officer\b", "Compliance Officer", "Compliance"),
    ],
    "Retail / Hospitality": [
        (r"\bcashier\b", "Cashier", "Retail"),
        (r"\bstore associate\b", "Store Associate", "Retail"),
        (r"\bretail associate\b", "Retail Associate", "Retail"),
        (r"\brestaurant\b", "Restaurant Staff", "Food Service"),
        (r"\bserver\b", "Server", "Food Service"),
        (r"\bbarista\b", "Barista", "Food Service"),
        (r"\bhotel\b", "Hotel Staff", "Hospitality"),
        (r"\bhospitality\b", "Hospitality Staff", "Hospitality"),
    ],
    "Manufacturing / Production": [
        (r"\bproduction worker\b", "Production Worker", "Production"),
        (r"\bmachine operator\b", "Machine Operator", "Production"),
        (r"\bassembler\b", "Assembler", "Production"),
        (r"\bmanufacturing\b", "Manufacturing Worker", "Manufacturing"),
        (r"\bproduction supervisor\b", "Production Supervisor", "Production"),
    ],
}

# The same for the incremental source, whose titles are lower-cased first.
TITLE_PATTERNS_BATCH = {
    "Data & Analytics": [
        (r"\bdata analyst\b", "Data Analyst", "Analytics"),
        (r"\bbusiness analyst\b", "Business Analyst", "Business Analysis"),
        (r"\bbusiness intelligence\b", "Business Intelligence Analyst", "BI"),
        (r"\bbi analyst\b", "Business Intelligence Analyst", "BI"),
        (r"\bdata scientist\b", "Data Scientist", "Data Science"),
        (r"\bdata engineer\b", "Data Engineer", "Data Engineering"),
        (r"\banalytics engineer\b", "Analytics Engineer", "Analytics"),
        (r"\bproduct analyst\b", "Product Analyst", "Product Analytics"),
    ],
    "IT / Software": [
        (r"\bai engineer\b", "AI Engineer", "AI Engineering"),
        (r"\bnlp data engineer\b", "NLP Data Engineer", "Data Engineering"),
        (r"\bsoftware engineer\b", "Software Engineer", "Software Development"),
        (r"\bsoftware developer\b", "Software Developer", "Software Development"),
        (r"\bbackend\b", "Backend Developer", "Software Development"),
        (r"\bfront end\b", "Frontend Developer", "Software Development"),
        (r"\bfrontend\b", "Frontend Developer", "Software Development"),
        (r"\bfullstack\b", "Full Stack Developer", "Software Development"),
        (r"\bfull stack\b", "Full Stack Developer", "Software Development"),
        (r"\b\.net developer\b", ".NET Developer", "Software Development"),
        (r"\bdevops\b", "DevOps Engineer", "Infrastructure"),
        (r"\bqa engineer\b", "QA Engineer", "Quality Assurance"),
        (r"\btest automation\b", "Test Automation Engineer", "Quality Assurance"),
        (r"\bsolution designer\b", "Solution Designer", "Solution Architecture"),
        (r"\bsolution architect\b", "Solution Architect", "Solution Architecture"),
        (r"\bproduct owner\b", "Product Owner", "Product Management"),
        (r"\bsecurity operations center\b", "SOC Engineer", "Cyber Security"),
        (r"\bsoc engineer\b", "SOC Engineer", "Cyber Security"),
        (r"\bcyber security\b", "Cyber Security Specialist", "Cyber Security"),
        (r"\binformation security\b", "Information Security Specialist", "Cyber Security"),
    ],
    "Finance & Accounting": [
        (r"\bfinancial analyst\b", "Financial Analyst", "Finance"),
        (r"\bfinance\b", "Finance Specialist", "Finance"),
        (r"\baccountant\b", "Accountant", "Accounting"),
        (r"\bchief accountant\b", "Chief Accountant", "Accounting"),
        (r"\bauditor\b", "Auditor", "Audit"),
        (r"\bit audit\b", "IT Auditor", "Audit"),
        (r"\binvestment analyst\b", "Investment Analyst", "Investment"),
        (r"\brelationship manager\b", "Relationship Manager", "Banking"),
    ],
    "Sales": [
        (r"\bsales executive\b", "Sales Executive", "Sales"),
        (r"\bsales manager\b", "Sales Manager", "Sales"),
        (r"\bsales lead\b", "Sales Lead", "Sales"),
        (r"\baccount executive\b", "Account Executive", "Sales"),
        (r"\baccount manager\b", "Account Manager", "Sales"),
        (r"\bbusiness development\b", "Business Development Specialist", "Sales"),
        (r"\bkey account\b", "Key Account Manager", "Sales"),
        (r"\binside sales\b", "Inside Sales Representative", "Sales"),
    ],
    "Marketing / Communications": [
        (r"\bmarketing specialist\b", "Marketing Specialist", "Marketing"),
        (r"\bmarketing manager\b", "Marketing Manager", "Marketing"),
        (r"\bdigital marketing\b", "Digital Marketing Specialist", "Digital Marketing"),
        (r"\bsocial media\b", "Social Media Specialist", "Digital Marketing"),
        (r"\bseo\b", "SEO Specialist", "Digital Marketing"),
        (r"\bsem\b", "SEM Specialist", "Digital Marketing"),
        (r"\bbrand\b", "Brand Specialist", "Brand"),
        (r"\bgrowth\b", "Growth Manager", "Growth"),
        (r"\buser acquisition\b", "User Acquisition Specialist", "Growth"),
    ],
    "Human Resources": [
        (r"\bhuman resources\b", "Human Resources Specialist", "HR"),
        (r"\bhr officer\b", "Human Resources Officer", "HR"),
        (r"\bhrbp\b", "HR Business Partner", "HR"),
        (r"\brecruitment\b", "Recruitment Specialist", "Recruitment"),
        (r"\brecruiter\b", "Recruiter", "Recruitment"),
        (r"\btalent acquisition\b", "Talent Acquisition Specialist", "Recruitment"),
        (r"\blearning partner\b", "Learning and Development Specialist", "Learning and Development"),
    ],
    "Healthcare": [
        (r"\bregistered nurse\b", "Registered Nurse", "Clinical Care"),
        (r"\bnurse\b", "Nurse", "Clinical Care"),
        (r"\bmedical\b", "Medical Specialist", "Healthcare"),
        (r"\bclinical\b", "Clinical Specialist", "Clinical Care"),
        (r"\bregulatory affairs\b", "Regulatory Affairs Specialist", "Regulatory Affairs"),
        (r"\blab manager\b", "Lab Manager", "Laboratory"),
    ],
    "Education / Training": [
        (r"\bteacher\b", "Teacher", "Teaching"),
        (r"\binstructor\b", "Instructor", "Teaching"),
        (r"\btrainer\b", "Trainer", "Training"),
        (r"\btraining\b", "Training Specialist", "Training"),
        (r"\blearning\b", "Learning Specialist", "Learning and Development"),
    ],
    "Logistics / Supply Chain": [
        (r"\blogistics\b", "Logistics Specialist", "Logistics"),
        (r"\bsupply chain\b", "Supply Chain Specialist", "Supply Chain"),
        (r"\bwarehouse\b", "Warehouse Specialist", "Warehousing"),
        (r"\btransportation\b", "Transportation Specialist", "Transportation"),
        (r"\bprocurement\b", "Procurement Specialist", "Procurement"),
        (r"\bpurchasing\b", "Purchasing Specialist", "Procurement"),
        (r"\bmaterial coordinator\b", "Material Coordinator", "Supply Chain"),
    ],
    "Customer Service": [
        (r"\bcustomer service\b", "Customer Service Representative", "Customer Service"),
        (r"\bcustomer support\b", "Customer Support Specialist", "Customer Support"),
        (r"\bcustomer success\b", "Customer Success Manager", "Customer Success"),
        (r"\bfield service\b", "Field Service Engineer", "Field Service"),
    ],
    "Engineering": [
        (r"\bmechanical\b", "Mechanical Engineer", "Engineering"),
        (r"\belectrical\b", "Electrical Engineer", "Engineering"),
        (r"\bcivil\b", "Civil Engineer", "Engineering"),
        (r"\bhardware\b", "Hardware Engineer", "Engineering"),
        (r"\bcad drafter\b", "CAD Drafter", "Design Engineering"),
        (r"\bdrafter\b", "Drafter", "Design Engineering"),
        (r"\bquality engineer\b", "Quality Engineer", "Quality Engineering"),
        (r"\btest engineer\b", "Test Engineer", "Testing Engineering"),
        (r"\bprocess engineer\b", "Process Engineer", "Process Engineering"),
        (r"\bengineer\b", "Engineer", "Engineering"),
    ],
    "Legal": [
        (r"\blegal\b", "Legal Specialist", "Legal"),
        (r"\blaw\b", "Legal Specialist", "Legal"),
        (r"\bcompliance\b", "Compliance Specialist", "Compliance"),
        (r"\bip associate\b", "IP Associate", "Intellectual Property"),
        (r"\btrade compliance\b", "Trade Compliance Specialist", "Compliance"),
    ],
    "Retail / Hospitality": [
        (r"\bhotel\b", "Hotel Staff", "Hospitality"),
        (r"\bresort\b", "Resort Staff", "Hospitality"),
        (r"\bhousekeeping\b", "Housekeeping Manager", "Hospitality"),
        (r"\brestaurant\b", "Restaurant Staff", "Food Service"),
        (r"\bcashier\b", "Cashier", "Retail"),
        (r"\bstore manager\b", "Store Manager", "Retail"),
    ],
    "Manufacturing / Production": [
        (r"\bproduction\b", "Production Specialist", "Production"),
        (r"\bmanufacturing\b", "Manufacturing Specialist", "Manufacturing"),
        (r"\bqc staff\b", "QC Staff", "Quality Control"),
        (r"\bquality control\b", "Quality Control Specialist", "Quality Control"),
        (r"\bsmt\b", "SMT Engineer", "Manufacturing Engineering"),
    ],
}
