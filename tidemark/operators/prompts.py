"""Prompt texts and their assembly as columns; no model is called here."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt wording, with {name} where a column goes. --------------------------------

ARTICLE_PART_PROMPT = """The following is a portion from an online article about the publicly listed company {company}:

    ###############################################################
    
    {docs}
    
    ###############################################################
    
    Based on this portion, please write a summary of the article that can be used with other summaries to create a final, consolidated summary of the article.

    Helpful Answer:"""

ARTICLE_REDUCE_PROMPT = """The following is a set of summaries from different portions of an online article about {company} the publicly listed company:

    ###############################################################

    {docs}

    ############################################################### 

    Take these and distill it into a final, consolidated summary of the article that is relevant to {company}. Ignore irrelevant information. If the article is irrelevant, return "Irrelevant Article"

    Helpful Answer:

    """

EVENT_PROMPT = """Below are AI generated summaries of the top articles for a given event about  {company} the company.  Ignore any irrelevant information that is not about  {company} the company. Write a concise summary of the following that is relevant to the publicly listed company {company}. If the article is completely irrelevant to {company} just return 'Irrelevant Article'. These are the summaries:  
    
    ###############################################################
    
    "{docs}"
    
    ###############################################################
    CONCISE SUMMARY:"""

SECTION_PROMPT = "Summarize the following document given it is part of a {ticker}'s {filing_type} filing with the SEC:\n\n{doc}"

QUESTION_PROMPT = """You are a financial expert that specializes in analyzing financial filings of publicly traded companies. Use the following pieces of context from the 10-K filing of the company to answer the question at the end. If you don't know the answer, just say that you don't know, don't try to make up an answer. Keep the answer as concise as possible. Restate the question in your answer.
        \n\n ########## \n \n
        Context:
        {context}
        \n\n ########## \n \n
        Question: {question}
        \n\n ########## \n \n
        Helpful Answer:"""

ENTITY_QUESTION_PROMPT = """You are a financial expert that specializes in analyzing financial filings of publicly traded companies. Use the following pieces of context from the 10-K filing of the company to answer the question at the end. Return the answer in following format: (Important Entity, Reason for importance). Note important entities should be proper nouns. If you don't know the answer, just say that you don't know, don't try to make up an answer. Keep the answer as concise as possible. Restate the question in your answer.
        \n\n ########## \n \n
        Context:
        {context}
        \n\n ########## \n \n
        Question: {question}
        \n\n ########## \n \n
        Helpful Answer:"""

COMBINE_PROMPT = "These are answers to a questions about a company from the company's 10-K filing with the SEC:\n\n{summaries} \n\n ########## \n \n Summarize the answers. If the summary says the question could not be answered, add a 0 at the end of the summary."

CHAT_COMBINE_PROMPT = "Below are the answers generated to the question:\n \n {question} \n \n Each of answers used some part of the company's 10-K filing with the SEC as context. \n\n Answers:\n\n##########\n\n{summaries} \n\n ########## \n \n Using these answers, generated an answer to the question. If an answer can not be generated, say that the question could not be answered, but suggest a question that could be answered using the context from a 10-K filing with the SEC."

RANKING_PROMPT = """You are a financial analyst that specializes in analyzing news that relates to publicly listed companies: in this case {company}. Your job is to analyze how a news event may affect a company's business given information laid out in their SEC fillings. 


                Below is a detailed context about {company}'s business according to their most recent 10-K filling:


                ###############################################################

                {context}

                ###############################################################

                Given the news: 

                {events}

                ###############################################################

                Rank these news events based on importance to Equity Researchers, and explain the criteria used for ranking. Note that the context of the analysis should be based on the provided context. 


            """

ANALYST_ROLE = "You are a financial analyst that specializes in analyzing news that relates to publicly listed companies: in this case {company}. Your job is to analyze the relevance of the events for someone interested in particular aspect of {company}."

RELEVANCE_PROMPT = """The context of interest is: {context}

Return an analysis of the these events below for someone interested in the context. Ignore irrelevant information. 

###############################################################

Given these news event summaries: 

{events}

###############################################################

Analysis:
"""

ALERT_PROMPT = """The context of interest is: {context}

Return an analysis of the these events below for someone interested in the context. Be succinct and ignore irrelevant events, don't include it in the analysis. The analysis format should be 

(Context of interest)

(Relevant Event Summary) 

Relevance: (Explanation of relevance)

###############################################################

Given these news event summaries: 

{events}

###############################################################

Analysis:
"""

QUERY_PROMPT = """
You are an expert in information retrieval. Your job is to turn the given query into a format such that when an embedding of the query is created to search cosine similarity with embeddings of news article summaries, the most relevant articles can be retrieved. For example, if the query is "What is Apple's strategy in China", the query should be formatted as "This article talks about Apple Inc's strategy about their business in China."

This is the query: "{query}" 

Just return the formatted query an no other information.

"""

QUERY_ROLE = """
You are an expert in information retrieval. Your job is to turn the given query into a format such that when an embedding of the query is created to search cosine similarity with embeddings of news article summaries, the most relevant articles can be retrieved. For example, if the query is "What is Apple's strategy in China", the query should be formatted as "This article is about Apple's strategy in China."
"""

QUERY_MESSAGE = """
This is the query: "{query}" 

Just return the formatted query an no other information.
"""

CHAT_ROLE = """
        The following is a friendly conversation between a human and an AI. The AI is talkative and provides lots of specific details from its context. The AI is also a financial expert that specializes in news about {context}. If the AI does not know the answer to a question, it truthfully says it does not know. Following is an analysis of the recent news that the AI can use to answer the Human's questions:
        
        ###############################################################
        {analysis}

    """

GREETING = (
    "Hi",
    "Hi, I am an AI Assistant that specializes in financial news. I can answer questions about the news and provide analysis.",
)

# Analysis kinds as (role, message).
ANALYSIS_KINDS = {
    "ranking": (None, RANKING_PROMPT),
    "relevance": (ANALYST_ROLE, RELEVANCE_PROMPT),
    "alert": (ANALYST_ROLE, ALERT_PROMPT),
    "query": (None, QUERY_PROMPT),
    "query_message": (QUERY_ROLE, QUERY_MESSAGE),
    "chat": (CHAT_ROLE, None),
}

# Topic and question template per company.
COMPANY_QUESTIONS = {
    "Industry Risk Management": "How is {company}'s management strategizing to adapt to or mitigate industry-specific challenges, including market competition and technology shifts?",
    "Macroeconomic Risks Management": "What actions is the {company} taking to manage exposure to macroeconomic variables like inflation, interest rates, or economic downturns?",
    "Business and Operating Risks Management": "How is the {company} planning to mitigate operational risks, such as supply chain disruptions, operational inefficiencies,or dependency on key clients?",
    "Fiscal Risks Internal to the Company Management": "What strategies does {company}'s management have to manage internal fiscal risks, such as credit risk, liquidity, and debt?",
    "Regulatory Compliance and Legal Risks Management": "What compliance and legal risk management strategies is the {company} employing, especially concerning environmental regulations, data protection laws, and intellectual property rights?",
    "Revenue and Profitability": "What is {company} management's perspective on Revenue trends and their effect on Gross Profit and Net Income?",
    "Cost Management": "How is {company}'s management controlling costs to maintain or improve Operating Income?",
    "Liquidity Concerns": "How does {company}'s management plan to balance Current Assets and Current Liabilities, specifically focusing on Inventories and Accounts Receivable?",
    "Capital Structure and Financing": "What is the {company} management's view on Total Debt, Interest Payments, and Interest Expense?",
    "Cash Flow Management": "How is {company} planning to generate and utilize Cash Flow from Operating Activities?",
    "Shareholder Value": "What strategies are in place to improve Average Shareholders' Equity and distribute Preferred Dividends?",
    "Earnings and Stock Valuation": "How does the {company} management view the current Stock Price in relation to Earnings and Weighted Average Shares Outstanding?",
    "Working Capital": "What is {company} management's strategy for managing working capital, focusing on Current Assets, Accounts Receivable, and Average Current Liabilities?",
    "Asset Management": "How does {company}'s management plan to optimize Total Assets, focusing on the relationship between Current Assets and Inventories?",
    "Overall Financial Health": "What is {company} management's commentary on the overall financial health of the company, focusing on key line items like Total Liabilities, Shareholders' Equity, and Cash Flow per Share?",
    "Industry Risks": "What industry-specific challenges or competitive pressures does the {company} acknowledge facing?",
    "Macroeconomic Risks": "How does {company} perceive risks related to economic cycles, inflation, or interest rates?",
    "Business and Operating Risks": "What are {company}'s stated risks regarding its core operations, such as supply chain disruptions, operational inefficiencies, or customer retention?",
    "Regulatory Compliance and Legal Risks": "What are the acknowledged risks concerning regulatory compliance, such as environmental regulations, data privacy, or intellectual property?",
    "Fiscal Risks Internal to the Company": "What internal fiscal risks such as credit risk, liquidity risk, or debt obligations does the {company} highlight?",
    "Company's Offerings and Revenue Streams": "How does the {company} describe its primary product lines, services, and associated revenue streams? How are they diversified, and what segments generate the most revenue? Key Elements: Product Line, Services, Revenue Streams",
    "Supply Chain Dynamics": "Can you provide details on the {company}'s supply chain management? Who are the key suppliers, partners, and intermediaries? What relationships or dependencies exist with these entities? Key Elements: Key Actors, Relationships in the Supply Chain",
    "Regulatory and Legal Landscape": "What is the legal and regulatory framework in which the {company} operates? Are there specific laws, regulations, or compliance requirements that significantly impact the business? Key Elements: Legal Environment",
    "Competitive Landscape": "Who are the {company}'s primary competitors in the market? What differentiates the company from these competitors, and how does it position itself in the industry? Key Elements: Main Competitors",
}
ENTITY_QUESTIONS = {
    "Key_Industry_Players": "Who are the key competitors and stakeholders that directly affect {company}'s industry risk management strategies?",
    "Differentiators_and_Vulnerabilities": "What competitive advantages or vulnerabilities does {company} identify in comparison to its key competitors?",
}

# Assembly -------------------------------------------------------------------------------------


def fill(template: str, **columns: Column | str) -> Column:
    """Template with its ``{name}`` places taken from columns; NULL if any is NULL."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts: list[Column] = []
    for i, piece in enumerate(pieces):
        if i % 2:
            value = columns[piece]
            parts.append(F.col(value) if isinstance(value, str) else value)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def split_complete(df: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every argument, and the quarantined rest."""
    complete = F.lit(True)
    for name in needed:
        complete = complete & F.col(name).isNotNull()
    return df.where(complete), df.where(~complete)


def analysis_prompts(df: DataFrame, kind: str, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``system`` and ``prompt`` texts of one analysis kind, and the rows
    that lack an argument."""
    ready, missing = split_complete(df, list(columns.values()))
    role, message = ANALYSIS_KINDS[kind]
    nothing = F.lit(None).cast("string")
    system = fill(role, **columns) if role else nothing
    prompt = fill(message, **columns) if message else nothing
    return ready.withColumns({"system": system, "prompt": prompt}), missing
