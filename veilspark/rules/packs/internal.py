"""Internal and proprietary material.

``needs``, ``words``, ``heads``, ``tails`` and ``digits`` say what every match
contains (see :class:`veilspark.rules.model.Rule`).  A scan skips the regex where
they are absent; they never change a result.
"""

# Rule ids, labels, severities, confidences and patterns.
PACK = {
    "pack": "internal",
    "rules": [
        {
            "id": "internal.classification_banner.v1",
            "name": "Confidentiality banner",
            "category": "internal",
            "subtype": "classification_banner",
            "severity": "medium",
            "confidence": 95,
            "pattern": r"(?i)\b(?:strictly )?(?:confidential(?: ?[—\-–] ?(?:internal only|board only|do not distribute))?|internal only|internal use only|proprietary and confidential|do not distribute|not for distribution|privileged and confidential|commercial in confidence)\b",
            "words": ["confidential", "only", "distribute", "distribution", "confidence"],
        },
        {
            "id": "internal.under_nda.v1",
            "name": "Material under NDA",
            "category": "internal",
            "subtype": "under_nda",
            "severity": "high",
            "confidence": 90,
            "pattern": r"(?i)\b(?:under (?:an )?NDA|subject to (?:an )?NDA|covered by (?:an )?NDA|NDA[- ]protected)\b",
            "words": ["nda"],
        },
        {
            "id": "internal.hostname.v1",
            "name": "Internal hostname",
            "category": "internal",
            "subtype": "internal_hostname",
            "severity": "medium",
            "confidence": 85,
            "pattern": r"\b[a-z0-9][a-z0-9-]*\.(?:internal|intranet|corp|local|lan|private)\.[a-z0-9.-]+\b|\b[a-z0-9-]+\.(?:internal|intranet|corp)\b",
            "words": ["internal", "intranet", "corp", "local", "lan", "private"],
        },
        {
            "id": "internal.private_ip.v1",
            "name": "Private network address",
            "category": "internal",
            "subtype": "private_ip",
            "severity": "low",
            "confidence": 80,
            "pattern": r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b",
            "words": ["10", "192", "172"],
        },
        {
            "id": "internal.admin_url.v1",
            "name": "Internal admin or staging URL",
            "category": "internal",
            "subtype": "internal_url",
            "severity": "medium",
            "confidence": 80,
            "pattern": r"https?://(?:admin|staging|stage|internal|intranet|dev|uat|preprod)[.-][a-z0-9.-]+",
            "needs": ["://"],
        },
        {
            "id": "internal.project_codename.v1",
            "name": "Project codename",
            "category": "internal",
            "subtype": "project_codename",
            "severity": "medium",
            "confidence": 70,
            "pattern": r"(?i)\b(?:project|programme|program|operation|codename[d]?)\s+([A-Z][a-z]{3,}\b)",
            "group": 1,
            "words": ["project", "programme", "program", "operation", "codename", "codenamed"],
        },
        # Matches nothing until a customer puts their own terms here.
        {
            "id": "internal.custom_term.v1",
            "name": "Customer-defined confidential term",
            "category": "internal",
            "subtype": "custom_term",
            "severity": "high",
            "confidence": 95,
            "pattern": r"(?!x)x",
            "words": ["(no such word)"],
        },
    ],
}
