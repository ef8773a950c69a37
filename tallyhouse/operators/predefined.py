"""The predefined domain contexts, as plain data."""

from __future__ import annotations

# They have to be the same wherever questions are classified.
PREDEFINED = [
    {
        "domain": "sales",
        "description": "Sales and revenue analytics, customer orders, product performance",
        "keywords": ["sales", "revenue", "orders", "customers", "products", "performance", "conversion"],
        "metrics": ["revenue", "orders", "conversion_rate", "avg_order_value"],
        "dimensions": ["product_category", "customer_segment", "time_period"],
        "tables": [
            {
                "name": "orders",
                "description": "Customer order transactions",
                "tags": ["sales", "transactions", "customers"],
            },
            {
                "name": "products",
                "description": "Product catalog and pricing",
                "tags": ["products", "pricing", "catalog"],
            },
        ],
        "glossary": [
            {
                "term": "Revenue",
                "definition": "Total income from sales",
                "synonyms": ["income", "sales", "earnings"],
            },
        ],
        "patterns": [
            {
                "pattern": "sales performance analysis",
                "intent": "analytics",
                "description": "Analysis of sales metrics and performance",
                "keywords": ["sales", "performance", "revenue"],
                "examples": ["show me sales data", "sales performance", "revenue analysis"],
            },
        ],
    },
    {
        "domain": "marketing",
        "description": "Marketing campaign performance, lead generation, customer acquisition analytics",
        "keywords": [
            "marketing", "campaign", "leads", "conversion", "acquisition", "cac", "roas", "attribution",
        ],
        "metrics": ["cac", "roas", "conversion_rate", "leads", "impressions", "clicks", "ctr"],
        "dimensions": ["campaign", "channel", "audience", "time_period"],
        "tables": [
            {
                "name": "campaigns",
                "description": "Marketing campaign data and performance",
                "tags": ["campaigns", "marketing", "advertising"],
            },
            {
                "name": "leads",
                "description": "Lead generation and conversion data",
                "tags": ["leads", "prospects", "conversion"],
            },
        ],
        "glossary": [
            {
                "term": "CAC",
                "definition": "Customer Acquisition Cost - cost to acquire one customer",
                "synonyms": ["acquisition cost", "customer cost"],
            },
            {
                "term": "ROAS",
                "definition": "Return on Ad Spend - revenue per dollar spent on advertising",
                "synonyms": ["ad return", "advertising roi"],
            },
        ],
        "patterns": [
            {
                "pattern": "marketing performance analysis",
                "intent": "analytics",
                "description": "Analysis of marketing campaign effectiveness and ROI",
                "keywords": ["marketing", "campaign", "performance", "conversion"],
                "examples": ["campaign performance", "marketing roi", "lead generation"],
            },
        ],
    },
    {
        "domain": "finance",
        "description": "Financial reporting, accounting, revenue and expense tracking",
        "keywords": ["finance", "accounting", "revenue", "expense", "profit", "cash", "budget"],
        "metrics": ["revenue", "profit", "expenses", "cash_flow", "margin", "roi"],
        "dimensions": ["account", "category", "period", "department"],
        "tables": [
            {
                "name": "transactions",
                "description": "Financial transaction records",
                "tags": ["finance", "transactions", "accounting"],
            },
        ],
        "glossary": [
            {
                "term": "ROI",
                "definition": "Return on Investment - profit relative to cost of investment",
                "synonyms": ["return on investment", "roi"],
            },
        ],
        "patterns": [
            {
                "pattern": "financial analysis",
                "intent": "analytics",
                "description": "Analysis of financial performance and profitability",
                "keywords": ["financial", "revenue", "profit", "expenses"],
                "examples": ["financial dashboard", "revenue analysis", "profit margins"],
            },
        ],
    },
    {
        "domain": "gaming",
        "description": "Video game sales, gaming industry analytics, platform performance",
        "keywords": ["gaming", "video games", "game sales", "platform", "genre", "entertainment"],
        "metrics": ["sales", "units_sold", "revenue", "market_share"],
        "dimensions": ["platform", "genre", "year", "region"],
        "tables": [
            {
                "name": "game_sales",
                "description": "Video game sales data by platform and genre",
                "tags": ["games", "sales", "entertainment"],
            },
        ],
        "glossary": [
            {
                "term": "Platform",
                "definition": "Gaming system or console (e.g., PlayStation, Xbox, Nintendo)",
                "synonyms": ["console", "system", "device"],
            },
        ],
        "patterns": [
            {
                "pattern": "gaming analytics",
                "intent": "analytics",
                "description": "Analysis of video game sales and performance",
                "keywords": ["game", "gaming", "video game", "sales"],
                "examples": ["video game sales", "gaming data", "game performance"],
            },
        ],
    },
    {
        "domain": "slack",
        "description": "Slack workspace analytics, channel activity, user engagement",
        "keywords": ["slack", "channels", "messages", "users", "workspace", "communication"],
        "metrics": ["messages", "active_users", "channel_activity", "response_time"],
        "dimensions": ["channel", "user", "date", "team"],
        "tables": [
            {
                "name": "slack_channels",
                "description": "Slack channel activity and engagement metrics",
                "tags": ["slack", "communication", "channels"],
            },
        ],
        "glossary": [],
        "patterns": [
            {
                "pattern": "slack analytics",
                "intent": "analytics",
                "description": "Analysis of Slack workspace activity and engagement",
                "keywords": ["slack", "channel", "messages", "communication"],
                "examples": ["slack dashboard", "channel activity", "slack metrics"],
            },
        ],
    },
    {
        "domain": "covid",
        "description": "COVID-19 vaccination data, pandemic statistics, public health metrics",
        "keywords": ["covid", "vaccine", "vaccination", "pandemic", "health", "immunization"],
        "metrics": ["vaccinated", "vaccination_rate", "doses_administered", "population_coverage"],
        "dimensions": ["state", "country", "date", "vaccine_type"],
        "tables": [
            {
                "name": "covid_vaccinations",
                "description": "COVID-19 vaccination data by location and time",
                "tags": ["covid", "vaccination", "health"],
            },
        ],
        "glossary": [],
        "patterns": [
            {
                "pattern": "covid analytics",
                "intent": "analytics",
                "description": "Analysis of COVID-19 vaccination and health data",
                "keywords": ["covid", "vaccine", "vaccination", "pandemic"],
                "examples": ["covid vaccine dashboard", "vaccination data", "pandemic metrics"],
            },
        ],
    },
]
