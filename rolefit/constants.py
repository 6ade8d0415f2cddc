"""Fixed values that must equal the original application's for equal results."""

# --- fixed values: section vocabularies (header lines, matched ignoring case) ---
RESUME_HEADERS = ("Professional Summary", "Summary", "Skills", "Experience", "Education",
                  "Projects", "Certifications")
JD_HEADERS = ("Job Title", "Description", "Responsibilities", "Requirements", "Qualifications",
              "Skills", "Benefits")

# --- fixed values: section-presence weights, in this order (also the expected order) ---
SECTION_WEIGHTS = (("skills", 40), ("experience", 30), ("education", 20), ("certifications", 10))

# --- fixed values: score weights (they sum to 1.05 in the original) ---
TOTAL_WEIGHTS = (("skill_match_score", 0.35), ("experience_score", 0.25), ("section_score", 0.15),
                 ("formatting_score", 0.10), ("job_title_score", 0.10),
                 ("keyword_density_score", 0.05), ("file_format_score", 0.05))

DEFAULT_JD_TITLE = "data scientist"

# --- fixed value: the experience date pattern (applied to lower-cased text) ---
DATE_RANGE_RE = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)?\s*\d{1,2}[-/]\d{2,4}|\d{4}[-–]\d{4}"
#: The digits of the scripts that Python's int() reads begin at these code points.
DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040,
               0x17E0, 0x1810, 0xFF10)

# --- fixed values: fonts accepted by the formatting check ---
ATS_FONTS = ("timesnewroman", "arial", "helvetica", "calibri")

# --- fixed values: messages, in the order the checks run ---
MSG_FONT = "Use ATS-friendly fonts: Times New Roman, Arial, Helvetica, or Calibri."
MSG_FONT_SIZE = "Maintain font sizes between 10–12pt."
MSG_TABLES = "Remove tables for ATS compatibility."
MSG_IMAGES = "Avoid images in resumes."
MSG_MARGINS = "Use 1-inch margins."
MSG_SCANNED = "Detected scanned PDF. Convert to text-based PDF."
MSG_FORMAT_ERROR = "Could not analyze formatting due to file error."
MSG_PDF_VERSION = "Use PDF version 1.4–1.7."
MSG_ENCODING = "Use UTF-8 or ASCII encoding."
MSG_DOCX = "PDF is preferred over DOCX for ATS."
MSG_OTHER_FORMAT = "Use PDF or DOCX format."
MSG_FILE_ERROR = "Could not verify file format."
MSG_EMPTY_INPUT = "Ensure both resume and job description contain valid text."
MSG_EXPERIENCE = "Enhance experience section with overlapping dates and relevant roles."
MSG_SECTIONS_LABELED = "Ensure section headers (Skills, Experience, Education) are clearly labeled."

# --- fixed values: title words that stay in header/summary lines (line-gap annotation) ---
TITLE_KEYWORDS = ("full stack", "software engineer")

# --- fixed value: adjectives removed from job titles before prompting (any case) ---
TITLE_ADJECTIVES_RE = r"\b(Dedicated|Results-driven|Broad-based|Experienced|Accomplished|Skilled|Proficient)\b\s*"

# --- fixed values: patterns of the entity extraction ---
NAME_RE = r"^[A-Za-z\s]+(?=\n)"
EMAIL_RE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_RE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
TITLE_AFTER_RE = r"(?:Professional Experience|Work Experience)[\s\S]*?(\w+\s+\w+)"
YEARS_RE = r"(\d+)\s*(?:year|yrs|years)"
SKILLS_AFTER_RE = r"(?:Skills|Technical Skills)[\s\S]*?((?:[A-Za-z\s,]+))"

# --- fixed values: cover-letter styles ---
LETTER_STYLES = ("Minimal", "Formal", "Modern")

# --- fixed values: chat template markers ---
CHAT_ROLES = ("user", "system", "assistant")
EOS_TOKEN = "</s>"

# --- fixed values: generation prompts (text around the form fields) ---
SUMMARY_PROMPT_HEAD = "### Instruction:\nGenerate a concise professional resume summary (100-150 characters) for a "
SUMMARY_PROMPT_MID1 = " with "
SUMMARY_PROMPT_MID2 = " years of experience and expertise in "
SUMMARY_PROMPT_TAIL = (". Focus on their skills, achievements, and commitment to excellence, without including "
                       "section headers or prefixes.\n\n### Response:\n")
LETTER_PROMPT_LABELS = ("Job Title: ", "Hiring Company: ", "Applicant Name: ", "Working Experience: ",
                        "Skillsets: ", "Cover Letter:\n")
LETTER_MARKER = "Cover Letter:"
RESPONSE_MARKER_RE = r"###\s*Response:?\s*"

# --- fixed values: letter layouts ---
FORMAL_NAME_GAP = 40
FORMAL_CONTACT_INDENT = 45
FORMAL_RULE = "-" * 60
MODERN_RULE = "_" * 54
DEFAULT_GREETING_NAME = "Hiring Manager"

# --- fixed values: validation messages ---
MSG_PROFILE_REQUIRED = "All required fields must be filled"
MSG_PROFILE_EXPERIENCE_PARTS = "Each experience entry must include at least Job Title, Company, and Dates"
MSG_PROFILE_ACHIEVEMENTS = "Achievements in experience entries cannot be empty if provided"
MSG_LETTER_REQUIRED = "Please fill in all required fields: Name, Job Title, Company, and Work Experience"
MSG_LETTER_STYLE = "Invalid template style selected."
MSG_UPLOAD_BOTH = "Please upload both resume and job description"
MSG_UPLOAD_FORMAT = "Invalid file format. Resume must be PDF/DOCX, JD must be PDF/DOCX/TXT"
MSG_EMAIL_TAKEN = "Email already registered"
MSG_EMAIL_MISSING = "An email address is required."

# --- fixed values: record rendering ---
NO_LINK = "No Link"
NO_LINK_HREF = "#"
DEFAULT_SUMMARY_HEAD = "Adaptive and versatile Frontend Developer with "
DEFAULT_SUMMARY_TAIL = " years of experience in HTML, CSS, JavaScript, Python"

# --- fixed values: section summaries and résumé suggestions ---
SUM_SKILLS = ("Proficient in ", " with expertise aligned to job requirements.")
SUM_NO_SKILLS = "No specific skills identified."
SUM_EXPERIENCE = ("+ years of professional experience ", ".")
SUM_FOCUS = "focusing on "
SUM_RELEVANT = "in relevant roles"
SUM_EDUCATION = ("Education: ", ".")
SUM_NO_EDUCATION = "No education details provided."
SUM_CERTS = ("Certified in ", ".")
SUM_NO_CERTS = "No certifications listed."
SUM_PROFESSIONAL = ("Skilled professional with expertise in ", ".")
SUGGEST_SKILLS = ("[SUGGESTED: Add skills - ", "]")
SUGGEST_SKILLS_NOTE = ("Added suggested skills (", ") to Skills section.")
SUGGEST_KEYWORDS = ("[SUGGESTED: Add keywords - ", "]")
SUGGEST_KEYWORDS_NOTE = ("Added suggested keywords (", ") to ", " section.")
SUGGESTION_SPAN = ("<span class='suggestion'>", "</span>")
