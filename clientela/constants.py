"""They have to read exactly like this for results to agree."""

INVOICED_STATUS = "FATURADO"
ONLINE_SYSTEM = "ECOM"
PHYSICAL_SYSTEM = "ERP"

# LIKE patterns, matched against the upper-cased customer name
OWN_SHOP_PATTERNS = ("%M A CONFEC%", "%N S CONFEC%")

# fragments of lower-cased store names offered as channels
STORE_FRAGMENTS = ("jardim", "bernardo")

ONLINE_LABEL = "E-commerce"
OMNICHANNEL_LABEL = "Omnichannel (online + loja)"
MULTI_STORE_LABEL = "Multi-loja (2 lojas físicas)"

# (prefix of the lower-cased category, label)
CATEGORY_PREFIXES = (("conjunto", "Conjunto"), ("vestido", "Vestido"))

STORE_SEPARATOR = " / "

TILES = 5
SAMPLE_ROWS = 5000
TOP_CATEGORIES = 10
HISTORY_ROWS = 50
LEAD_DAYS = 7

OTHER_SEGMENT = "Hibernating"
SEGMENTS_IN_DANGER = ("At Risk", "Cannot Lose Them")

# period presets, in menu order
LAST_30_DAYS = "Últimos 30 dias"
LAST_90_DAYS = "Últimos 90 dias"
LAST_12_MONTHS = "Últimos 12 meses"
THIS_YEAR = "Este ano"
EVERYTHING = "Tudo"
PERIOD_PRESETS = (LAST_30_DAYS, LAST_90_DAYS, LAST_12_MONTHS, THIS_YEAR, EVERYTHING)

# days before the day in question
PRESET_DAYS = {LAST_30_DAYS: 30, LAST_90_DAYS: 90}

# campaign objectives
REACTIVATION = "Reativação (inativos)"
REPURCHASE = "Recompra (ativos)"
VIP = "VIPs / Champions"
MONTH_BIRTHDAYS = "Aniversariantes do mês"
RFM_SEGMENT = "Segmento RFM"
CUSTOM = "Personalizado"

# objective: the bounds it sets; None is no limit
OBJECTIVE_BOUNDS = {
    REACTIVATION: dict(min_days=90, max_days=None, min_orders=1, min_spend=0),
    REPURCHASE: dict(min_days=30, max_days=89, min_orders=1, min_spend=0),
    VIP: dict(min_days=0, max_days=None, min_orders=3, min_spend=500),
}

# destinations that a list of stores leaves out
OTHER_STORES = "Outras lojas"

# names of the warehouse tables and the columns read from them
WAREHOUSE_TABLES = {
    "customers": "trusted_clientes",
    "sales": "trusted_pedidos",
    "items": "trusted_itens_pedido",
    "payments": "trusted_pagamentos",
}
WAREHOUSE_COLUMNS = {
    "customers": {
        "documento": "customer_id",
        "nome_completo": "full_name",
        "email": "email",
        "ddd": "area_code",
        "telefone": "phone",
        "data_nascimento": "birth_date",
        "cidade": "city",
        "estado": "state",
    },
    "sales": {
        "documento": "customer_id",
        "pedido_id": "order_id",
        "numero_pedido": "order_number",
        "loja": "store",
        "origem_sistema": "source_system",
        "data_pedido": "order_ts",
        "status_pedido": "status",
        "total_pedido": "order_total",
        "desconto": "discount",
    },
    "items": {
        "pedido_id": "order_id",
        "categoria": "category",
        "preco_total": "line_total",
        "quantidade": "quantity",
        "data_pedido": "order_ts",
    },
    "payments": {
        "pedido_id": "order_id",
        "forma_pagamento": "method",
        "valor_pagamento": "amount",
        "status_pagamento": "status",
        "data_pedido": "order_ts",
    },
}

# headings of the lists shown and exported
SEGMENT_HEADINGS = {
    "full_name": "Nome",
    "email": "E-mail",
    "whatsapp": "WhatsApp",
    "recency_days": "Dias s/ comprar",
    "frequency": "Pedidos",
    "value": "LTV (R$)",
    "ticket_per_order": "Ticket Médio (R$)",
}
BASE_HEADINGS = {
    "full_name": "Nome",
    "email": "E-mail",
    "whatsapp": "WhatsApp",
    "city": "Cidade",
    "stores": "Canais",
    "orders": "Pedidos",
    "mean_row_value": "Ticket Médio (R$)",
    "spend": "LTV (R$)",
    "last_purchase": "Última Compra",
    "idle_days": "Dias s/ comprar",
}
CAMPAIGN_HEADINGS = {
    "full_name": "Nome Completo",
    "first_name": "Primeiro Nome",
    "email": "E-mail",
    "whatsapp": "WhatsApp (55DDD...)",
    "city": "Cidade",
    "stores": "Canais",
    "idle_days": "Dias s/ comprar",
    "birth_date": "Aniversário",
    "segment": "Segmento RFM",
    "orders": "Pedidos",
    "spend": "LTV (R$)",
    "mean_row_value": "Ticket Médio (R$)",
    "campaign": "Campanha",
}
BIRTHDAY_HEADINGS = {
    "birth_day": "Dia",
    "full_name": "Nome Completo",
    "first_name": "Primeiro Nome",
    "email": "E-mail",
    "whatsapp": "WhatsApp",
    "city": "Cidade",
    "stores": "Canais",
    "orders": "Pedidos",
    "spend": "LTV (R$)",
    "last_purchase": "Última Compra",
    "idle_days": "Dias s/ comprar",
}
