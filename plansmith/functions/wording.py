"""Wordings of requests by family, with slots {en} and {zh} for clauses, {filters}, {rank}, {rank_en}, {rank_zh}, {limit} and {registry}."""

from __future__ import annotations

# Templates of each family, used in turn.
TEMPLATES = {
    "anti_hype": [
        "Compile this {registry} candidate request to JSON only: {filters}; rank={rank}; top={limit}.",
        "Need an executable protein-candidate query. Constraints: {filters}. Ranking: {rank}. Return top {limit} only.",
        "请把这个检索需求编译成可执行 JSON，不要解释：{filters}；排序 {rank}；只要前 {limit} 个。",
        "只输出查询 JSON。需求如下：{filters}。排序规则：{rank}。结果数：{limit}。",
        "Convert the following retrieval request into {registry} JSON: {filters}; {rank}; limit {limit}.",
        "数据库筛选请求，不要总结：{filters}；按 {rank}；top {limit}；输出 JSON。",
    ],
    "v10": [
        "From the {registry} registry, pull candidates with {en}; {rank_en}; stop after {limit} results.",
        "I am shortlisting entries from the candidate table. Keep records that have {en} and then {rank_en}; cap the list at {limit}.",
        "For this screen, I only want molecules with {en}. After ranking by binding strength, return the first {limit}.",
        "请按数据库语义理解这个检索：我要 {zh} 的候选，{rank_zh}，最多保留 {limit} 条。",
        "我在库里做初筛，只看 {zh} 的记录，最后 {rank_zh}，只留前 {limit} 个。",
        "研究问题是这样的：候选必须满足 {zh}；结果部分请 {rank_zh}；返回数量不要超过 {limit}。",
        "Keep a database shortlist for candidates showing {en}. Order the list with the best affinity first and keep only {limit}.",
        "做一个候选清单给我，条件是 {zh}，并且 {rank_zh}，最终看前 {limit} 条。",
    ],
    "v12": [
        "Search the candidate registry for entries satisfying {en}. Keep the top {limit} after sorting by binding potency.",
        "I need a candidate shortlist restricted to {en}; prioritize better affinity values and trim the output to {limit}.",
        "Within the protein-candidate table, retain only rows with {en}. Rank by affinity quality and keep no more than {limit} hits.",
        "请直接按数据库语义筛选：候选需要满足 {zh}，随后按结合强度优先，只保留 {limit} 条。",
        "做一个不带解释的候选筛选，约束是 {zh}，并按亲和力优先，输出不要超过 {limit} 条。",
        "我想从候选库里锁定 {zh} 的分子，排序时先看最强结合，名单控制在 {limit} 个以内。",
        "Build a database shortlist for candidates meeting {en}. Put the best binders first and stop once {limit} rows remain.",
        "候选初筛条件如下：{zh}；请先看结合最强的，再把结果截到 {limit} 条。",
    ],
    "v13": [
        "Filter the candidate inventory down to rows annotated with {en}. Then rank the survivors by measured binding quality and return at most {limit}.",
        "For downstream review, retain only protein candidates tagged with {en}. Put the highest-priority binders first and show no more than {limit} records.",
        "Database query request: among candidate entries, keep those marked as {en}; sort from best measured affinity to weaker binding and stop at {limit}.",
        "请从候选表里筛出满足 {zh} 的条目，然后按测得亲和力优先排序，结果上限 {limit} 条。",
        "只保留 {zh} 的候选，查看时先放最强结合的记录，最多输出 {limit} 条。",
        "我要一个数据库候选列表，要求 {zh}，并按最佳亲和力优先，最终不要超过 {limit} 项。",
        "Keep candidate rows carrying {en}. Arrange the output by strongest measured affinity and cap the response at {limit}.",
        "候选清单需求：{zh}；结果按最优结合强度排序；输出限制为 {limit} 条。",
    ],
    "v15": [
        "Within the curation pass, keep candidate records tagged with {en}. Let measured binder priority decide the order and cut the sheet down to {limit} rows.",
        "Need a review-ready candidate slate where the annotations say {en}. Arrange entries by tighter measured binding before weaker ones; output ceiling {limit}.",
        "From the candidate ledger, retain only rows carrying {en}. Use experimental binder strength as the ordering signal and stop once {limit} remain.",
        "请在候选账本里保留标注为 {zh} 的条目，按实测结合更强者靠前，最终收敛到 {limit} 条。",
        "我只要注释上写着 {zh} 的候选，查看顺序按实测结合由强到弱，名单压到 {limit} 条。",
        "做一个候选留样单：满足 {zh}；排序依据是实测结合更强者靠前；结果封顶 {limit} 条。",
        "Keep a curation-ready shortlist for rows labeled {en}. Resolve ordering with measured binding tightness and keep the sheet at {limit} rows or fewer.",
        "库内复核时只看 {zh} 的候选，排序遵循实测结合更强优先，最后不要留过 {limit} 条。",
    ],
    "engineered_bridge": [
        "For the curation worksheet, keep entries whose annotation block says {en}. Rank them by measured binding strength and return at most {limit}.",
        "I need a review sheet of candidates marked {en}. Order the rows by observed affinity quality and cap the list at {limit}.",
        "Screen candidate annotations for {en}. Use measured binding evidence as the ranking signal and stop at {limit} results.",
        "做数据库复核单，只保留注释栏注明 {zh} 的候选，按实测结合强度排序，最多 {limit} 条。",
        "候选审阅表里只放 {zh} 的记录，顺序参考实测亲和力强弱，数量上限 {limit}。",
        "按注释信息筛候选：满足 {zh}，再按实测结合由强到弱排，保留前 {limit} 条。",
    ],
    "final_bridge": [
        "Review the candidate ledger and keep entries annotated with {en}. Let measured binder tightness set the order and stop at {limit} rows.",
        "Prepare a shortlist sheet for candidate records carrying {en}. Use experimental binding tightness as the priority signal and cap the output at {limit}.",
        "For curation handoff, retain only candidate rows marked {en}. Rank them by measured binder evidence and keep no more than {limit} results.",
        "做候选账页复核，只留下标注为 {zh} 的条目，排序看实测结合紧密度，最多 {limit} 条。",
        "整理一个候选留样清单，记录需要满足 {zh}，优先级按实验结合紧密度走，数量压到 {limit} 条以内。",
        "交付复核时，只保留 {zh} 的候选，顺序由实测结合证据决定，最终不超过 {limit} 条。",
    ],
    "completion": [
        "During curation review, keep candidate rows annotated with {en}. Let measured binder ranking determine the order and trim the sheet to {limit} rows.",
        "In the candidate ledger, retain rows carrying {en}. Use measured binding strength to order the records and stop after {limit}.",
        "Keep a curation shortlist for entries labeled {en}. Resolve the order with measured binding tightness and leave no more than {limit} rows.",
        "Build a reviewer slate for candidates whose annotations read {en}. Arrange the list by tighter measured binding and cap the output at {limit}.",
        "For screening handoff, keep only records marked {en}. Rank them by measured binder priority and return up to {limit} rows.",
    ],
    "knottin_high": [
        "From the candidate ledger, keep rows carrying {en}. Use experimental binder strength as the ordering signal and stop after {limit} remain.",
        "Keep a curation-ready shortlist of rows labeled {en}. Resolve ordering with measured binding tightness and keep the sheet at {limit} rows or fewer.",
    ],
    "hotspot_contrast": [
        "Keep a curation-ready shortlist for candidate rows labeled {en}. Resolve ordering with measured binding tightness and keep the sheet at {limit} rows or fewer.",
        "Prepare a curation-ready shortlist for rows labeled {en}. Use measured binder priority to order the sheet and stop once {limit} rows remain.",
        "Need a curation-ready shortlist for rows labeled {en}. Let measured binding tightness determine the order and cap the list at {limit}.",
    ],
    "hotspot_prefix": [
        "Keep a curation-ready shortlist for rows labeled {en}. Use measured binder strength as the ordering signal and stop once {limit} remain.",
        "Keep a curation-ready shortlist for rows labeled {en}. Let measured binder priority decide the order and cap the list at {limit}.",
        "Keep a curation-ready shortlist for rows labeled {en}. Arrange entries by tighter measured binding before weaker ones and keep no more than {limit}.",
    ],
    "train": [
        "找 {zh_filters}，{order_zh}，先给我前 {limit} 个。",
        "帮我筛一批 {zh_filters} 的候选，{order_zh}，先给我前 {limit} 个。",
        "把数据库里符合 {zh_filters} 的 candidate 找出来，{order_zh}，limit {limit}。",
        "我要查 {zh_filters} 的 protein candidate，{order_zh}，top {limit}。",
        "按真实 {registry} 字段编译这个请求：{zh_filters}，{order_zh}，先给我前 {limit} 个。",
        "给我一个 candidate_search 计划，条件是 {zh_filters}，{order_zh}，先给我前 {limit} 个。",
        "严格输出 slot sketch：scaffold_type 直接复制请求里的 scaffold 名，oral 只能写 High/Low/Medium，engineered 用 true/false。请求是：{zh_filters}，{order_zh}，先给我前 {limit} 个。",
        "Compile this {registry} candidate request to JSON only: {filters}; rank={rank}; top={limit}.",
        "Need an executable protein-candidate query. Constraints: {filters}. Ranking: {rank}. Return top {limit} only.",
        "Convert the following retrieval request into {registry} JSON: {filters}; {rank}; limit {limit}.",
        "数据库筛选请求，不要总结：{filters}；按 {rank}；top {limit}；输出 JSON。",
        "只输出查询 JSON。需求如下：{filters}。排序规则：{rank}。结果数：{limit}。",
        "Translate this retrieval intent into compact slot-sketch JSON only: {filters}; ranking={rank}; limit={limit}.",
    ],
    "hard": ["帮我筛一批 {zh_filters} 的候选，口径按真实数据库字段来，{order_zh}，先给我前 {limit} 个。", "按数据库字段理解这句话：{zh_filters}，{order_zh}，先给我前 {limit} 个。"],
    "dev": ["找 {zh_filters}，{order_zh}，limit {limit}。", "筛 {zh_filters}，{order_zh}，前 {limit}。"],
    "seen": ["找 {zh_filters}，按 affinity 最强排前 {limit}，输出查询计划 JSON。"],
    "seen_unordered": ["找 {zh_filters} 前 {limit}，输出查询计划 JSON。"],
}
# How each family speaks of the order, in English and Chinese, where the plan has one.
RANKS = {
    "v10": ("keep the strongest binders first", "把结合最强的放在最前面"),
    "v12": ("prioritize stronger affinity", "按结合强度优先"),
    "v13": ("best measured affinity first", "按最佳亲和力优先"),
    "v15": ("measured binding tighter to weaker", "实测结合更强者靠前"),
}
UNRANKED = ("no extra ranking is needed", "不需要额外排序")
