"""Small dimensions: fixed values that results depend on, as plain lists, and frames made of them."""

from pyspark.sql import DataFrame, SparkSession

RULE_VERSION = "v1.0.0"

#: Severities from mild to grave.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

#: Parameters of a query string that only track, besides utm_*.
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "yclid", "vero_id", "wickedid", "hsa_cam", "hsa_grp", "hsa_ad", "hsa_src", "hsa_tgt", "hsa_kw", "hsa_mt", "hsa_net", "hsa_ver", "_ga", "_gl"]

#: Sites behind a login, and address ranges that are never fetched.
LOGIN_WALLED = ["linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com"]
BLOCKED_RANGES = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "192.0.0.0/24", "198.18.0.0/15"]
BLOCKED_RANGES_V6 = ["::/128", "::1/128", "fe80::/10", "fc00::/7", "ff00::/8", "64:ff9b::/32"]

#: Titles dropped from names.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "er", "eng", "shri", "shrimati", "smt", "sir", "madam"]

#: Common first names, then common family names.
COMMON_NAMES = """
rahul amit rohit priya pooja neha anjali vikram abhishek aditya anand arjun deepak dinesh gaurav karan manish mayank
mohit nithin nisha pankaj prateek rajesh ramesh sanjay saurabh shivam sneha sonam suresh varun vargas vijay vipin vishal
vivek yash aakash aarti swati divya kavita megha payal rinku riya roshni shweta sunita
kumar sharma singh verma gupta patel shah reddy rao joshi kulkarni nair pillai khan ali roy mehta agarwal mishra prasad
chandra jain bhat bhatt sen ghosh dutta bose mukherjee banerjee chatterjee kapoor malhotra khanna saxena srivastava yadav
chauhan rathore thakur deshmukh patil pawar shinde jadhav gaikwad hegde shetty gowda naidu choudhury biswas chakraborty
dube dubey tripathi tiwari pandey dixit bhatnagar
""".split()

#: Labels of a name recognizer and the entity types they mean.
NER_TYPES = {"person": "PERSON", "people": "PERSON", "organization": "ORGANIZATION", "org": "ORGANIZATION", "company": "ORGANIZATION", "location": "LOCATION", "loc": "LOCATION", "city": "LOCATION", "state": "LOCATION", "country": "LOCATION", "address": "ADDRESS", "street_address": "ADDRESS", "email": "EMAIL", "phone": "PHONE", "phone_number": "PHONE"}

#: Holder classes (fourth letter) of a PAN.
PAN_HOLDERS = "PCHFATBLJG"

#: Threat codes and categories.
THREATS = {
    "CREDENTIAL_STUFFING": "CREDENTIAL",
    "ACCOUNT_TAKEOVER": "CREDENTIAL",
    "TARGETED_PHISHING": "PHISHING",
    "SOCIAL_ENGINEERING": "PHISHING",
    "PHYSICAL_TARGETING": "PHYSICAL",
    "STALKING_RISK": "PHYSICAL",
    "IMPERSONATION": "IDENTITY",
    "IDENTITY_FRAUD_ENABLEMENT": "IDENTITY",
    "INFORMATIONAL": "INFO",
}

#: Actions, with the order in which they come; equal orders come as listed.
ACTIONS = {"VERIFY_BEFORE_ACTION": 1, "CHANGE_PASSWORD": 1, "CHECK_PASSWORD_REUSE": 2, "ENABLE_MFA": 3, "REVOKE_SESSIONS": 4, "OPT_OUT_BROKER": 1, "CONTACT_PUBLISHER_REDACTION": 7, "REQUEST_REMOVAL": 5, "REVIEW_VISIBILITY": 6}

#: Numbering plans: country code and the pattern of a national number.
NUMBER_PLANS = {"91": "[6-9]\\d{9}", "1": "[2-9]\\d{2}[2-9]\\d{6}", "44": "7\\d{9}|[12]\\d{8,9}", "49": "1[5-7]\\d{8,9}|[2-9]\\d{6,10}", "33": "[1-9]\\d{8}", "34": "[6-9]\\d{8}"}

#: A broker catalog over hosts of the pages table: name, domain, opt-out page, other domains.
BROKERS = [
    ("Therhe People", "therhe.example.org", "https://therhe.example.org/opt-out", ["therhe.example.com"]),
    ("Tionsh Lookup", "tionsh.example.com", "https://tionsh.example.com/remove", []),
    ("Example Net Index", "example.net", "https://example.net/privacy", ["example.edu"]),
    ("Example Org Index", "example.org", "https://example.org/privacy", []),
]


def brokers(spark: SparkSession) -> DataFrame:
    """name, domain, opt_out_url, domains, position (in the catalog)."""
    rows = [(*b, i) for i, b in enumerate(BROKERS)]
    return spark.createDataFrame(rows, "name string, domain string, opt_out_url string, domains array<string>, position int")


def threats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(THREATS.items()), "threat string, category string")
