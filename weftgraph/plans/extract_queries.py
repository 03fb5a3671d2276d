"""Extractors over trees of files made from the tables: a file a row, of every family of kinds.

Rows of a result are nodes (id, label, type, file type), edges (source, target, relation, confidence) or calls (caller,
class, method), told apart by ``what``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.extract import extract
from weftgraph.extract.fragments import Fragments
from weftgraph.sources import files as tree
from weftgraph.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
NS = 'xmlns="http://soap.sforce.com/2006/04/metadata"'
BASE = "/p/force-app/main/default/"


def query(*selects: str, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = ctes + " UNION ALL ".join(selects)
        return f

    return add


def fill(template: str) -> Column:
    """A text with ``{column}`` for columns."""
    parts, at = [], 0
    for piece in template.replace("}", "{").split("{"):
        parts.append(F.lit(piece) if at % 2 == 0 else F.col(piece).cast("string"))
        at += 1
    return F.concat(*parts)


def file_of(df: DataFrame, path: str, text: str) -> DataFrame:
    return df.select(fill(BASE + path).alias("path"), fill(text).cast("binary").alias("content"))


def read_tree(*parts: DataFrame) -> Fragments:
    files = reduce(DataFrame.unionAll, parts)
    return extract(files.withColumn("kind", tree.kind_of("path")).where("kind is not null"))


def found(got: Fragments, calls: bool = False) -> DataFrame:
    nodes = got.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("sf_type").alias("c"), F.col("file_type").alias("d"))
    edges = got.edges.select(F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c"), F.col("confidence").alias("d"))
    out = nodes.unionAll(edges)
    return out.unionAll(got.calls.select(F.lit("call"), "caller_id", "callee_class", "callee_method", F.lit(None).cast("string"))) if calls else out


def n(id_: str, label: str, sf_type: str, file_type: str, table: str) -> str:
    return f"SELECT 'node' AS what, {id_} AS a, {label} AS b, '{sf_type}' AS c, '{file_type}' AS d FROM {table}"


def e(source: str, target: str, relation: str, confidence: str, table: str) -> str:
    return f"SELECT 'edge' AS what, {source} AS a, {target} AS b, '{relation}' AS c, '{confidence}' AS d FROM {table}"


@query(
    n("'apex_cust' || c_custkey", "'Cust' || c_custkey", "ApexClass", "apex", "customer"),
    n("'method_cust' || c_custkey || '_run'", "'Cust' || c_custkey || '.run()'", "ApexMethod", "apex", "customer"),
    e("'apex_cust' || c_custkey", "'apex_base' || c_nationkey", "extends", "INFERRED", "customer"),
    e("'apex_cust' || c_custkey", "'apex_face' || c_nationkey", "implements", "INFERRED", "customer"),
    e("'apex_cust' || c_custkey", "'apex_other'", "implements", "INFERRED", "customer"),
    e("'apex_cust' || c_custkey", "'method_cust' || c_custkey || '_run'", "contains", "EXTRACTED", "customer"),
    e("'apex_cust' || c_custkey", "'object_account' || c_nationkey", "queries", "EXTRACTED", "customer"),
    e("'apex_cust' || c_custkey", "'object_order__c'", "dml", "INFERRED", "customer"),
    e("'apex_cust' || c_custkey", "'flow_flow' || c_nationkey", "invokes", "EXTRACTED", "customer"),
    e("'apex_cust' || c_custkey", "'namedcredential_nc' || c_nationkey", "makes_callout", "EXTRACTED", "customer"),
    e("'apex_cust' || c_custkey", "'object_ev' || c_nationkey || '__e'", "publishes", "EXTRACTED", "customer"),
    e("'apex_cust' || c_custkey", "'custommetadata_set' || c_nationkey || '__mdt'", "reads_config", "INFERRED", "customer"),
    "SELECT 'call', 'method_cust' || c_custkey || '_run', 'Helper' || c_custkey, 'log', NULL FROM customer",
)
def extract_classes(spark, d):
    """A class a customer: comments and strings hold verbs, braces and calls that don't count."""
    text = """// insert ghost; Ghost.call();
public with sharing class Cust{c_custkey} extends Base{c_nationkey} implements Face{c_nationkey}, Other<Map<String, Id>> <
  /* public class Not > */
  public void run(Order__c ord) <
    String s = 'delete ord; > Ghost.call()';
    insert ord;
    Helper{c_custkey}.log(s);
    List<Account> accs = [SELECT Id FROM Account{c_nationkey} LIMIT 1];
    Flow.Interview.Flow{c_nationkey} f = null;
    req.setEndpoint('callout:NC{c_nationkey}/v1');
    EventBus.publish(new Ev{c_nationkey}__e());
    Object o = Set{c_nationkey}__mdt.getInstance('x');
  >
>
"""
    # angle brackets at line ends stand for braces
    text = text.replace(" <\n", " \x01\n").replace(" > ", " \x02 ").replace("  >\n", "  \x02\n").replace("\n>\n", "\n\x02\n")
    files = file_of(T.read(spark, d, "customer"), "classes/Cust{c_custkey}.cls", text)
    files = files.withColumn("content", F.translate(F.decode("content", "UTF-8"), "\x01\x02", "{}").cast("binary"))
    got = read_tree(files)
    got.calls = got.calls.where("callee_class like 'Helper%'")
    return found(got, calls=True)


@query(
    n("'trigger_t' || s_suppkey", "'T' || s_suppkey", "ApexTrigger", "apex", "supplier"),
    e("'trigger_t' || s_suppkey", "'object_obj' || s_nationkey || '__e'", "triggers", "EXTRACTED", "supplier"),
    e("'trigger_t' || s_suppkey", "'object_obj' || s_nationkey || '__e'", "subscribes", "EXTRACTED", "supplier"),
    "SELECT 'call', 'trigger_t' || s_suppkey, 'Handler' || s_suppkey, 'run', NULL FROM supplier",
)
def extract_triggers(spark, d):
    text = "trigger T{s_suppkey} on Obj{s_nationkey}__e (after insert, after update) \x01 Handler{s_suppkey}.run(Trigger.new); \x02"
    files = file_of(T.read(spark, d, "supplier"), "triggers/T{s_suppkey}.trigger", text)
    return found(read_tree(files.withColumn("content", F.translate(F.decode("content", "UTF-8"), "\x01\x02", "{}").cast("binary"))), calls=True)


P = "(SELECT *, CASE p_size % 3 WHEN 0 THEN 'Lookup' WHEN 1 THEN 'MasterDetail' ELSE 'Text' END AS kind FROM part)"
FIELD = "'field_obj' || p_size || '__c_f' || p_partkey || '__c'"


@query(
    n(FIELD, "'Obj' || p_size || '__c.F' || p_partkey || '__c'", "CustomField", "object", P),
    e("'object_obj' || p_size || '__c'", FIELD, "contains", "EXTRACTED", P),
    f"SELECT 'edge', {FIELD}, 'object_to' || p_size, CASE kind WHEN 'Lookup' THEN 'references' ELSE 'master_detail' END, 'EXTRACTED' FROM {P} WHERE kind <> 'Text'",
    f"SELECT 'edge', {FIELD}, 'object_account', CASE kind WHEN 'Lookup' THEN 'references' ELSE 'master_detail' END, 'EXTRACTED' FROM {P} WHERE kind <> 'Text'",
    e(FIELD, "'globalvalueset_vs' || p_size", "uses", "EXTRACTED", P),
    *[n(f"'object_supp' || s_suppkey || '{tail}'", f"'Supp' || s_suppkey || '{tail}'", t, "object", f"supplier WHERE s_suppkey % 4 = {k}") for k, tail, t in ((0, "__x", "ExternalObject"), (1, "__e", "PlatformEvent"), (2, "__c", "CustomSetting"), (3, "", "CustomObject"))],
    e("'object_supp' || s_suppkey || '__x'", "'externaldatasource_ds' || s_nationkey", "backed_by", "EXTRACTED", "supplier WHERE s_suppkey % 4 = 0"),
    n("'validationrule_obj' || s_nationkey || '__c_vr' || s_suppkey", "'Obj' || s_nationkey || '__c: VR' || s_suppkey", "ValidationRule", "object", "supplier"),
    e("'object_obj' || s_nationkey || '__c'", "'validationrule_obj' || s_nationkey || '__c_vr' || s_suppkey", "contains", "EXTRACTED", "supplier"),
    e("'validationrule_obj' || s_nationkey || '__c_vr' || s_suppkey", "'field_obj' || s_nationkey || '__c_amt' || s_suppkey || '__c'", "references", "INFERRED", "supplier"),
    e("'validationrule_obj' || s_nationkey || '__c_vr' || s_suppkey", "'field_obj' || s_nationkey || '__c_name'", "references", "INFERRED", "supplier"),
    n("'layout_obj' || n_nationkey || '_main'", "'Obj' || n_nationkey || '-Main'", "Layout", "layout", "nation"),
    e("'layout_obj' || n_nationkey || '_main'", "'object_obj' || n_nationkey", "references", "EXTRACTED", "nation"),
    e("'layout_obj' || n_nationkey || '_main'", "'field_obj' || n_nationkey || '_r' || n_regionkey || '__c'", "uses", "EXTRACTED", "nation"),
)
def extract_objects(spark, d):
    """Fields from parts; objects and validation rules from suppliers; layouts from nations."""
    part = T.read(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 3 == 0, "Lookup").when(F.col("p_size") % 3 == 1, "MasterDetail").otherwise("Text"))
    fields = file_of(part, "objects/Obj{p_size}__c/fields/F{p_partkey}__c.field-meta.xml", f"<CustomField {NS}><fullName>F</fullName><type>{{kind}}</type><referenceTo>To{{p_size}}</referenceTo><referenceTo>Account</referenceTo><valueSet><valueSetName>VS{{p_size}}</valueSetName></valueSet></CustomField>")
    s = T.read(spark, d, "supplier").withColumn("tail", F.element_at(F.array(F.lit("__x"), F.lit("__e"), F.lit("__c"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int"))).withColumn("setting", F.when(F.col("tail") == "__c", "List").otherwise(""))
    objects = file_of(s, "objects/Supp{s_suppkey}{tail}/Supp{s_suppkey}{tail}.object-meta.xml", f"<CustomObject {NS}><label>S</label><customSettingsType>{{setting}}</customSettingsType><externalDataSource>DS{{s_nationkey}}</externalDataSource></CustomObject>")
    rules = file_of(s, "objects/Obj{s_nationkey}__c/validationRules/VR{s_suppkey}.validationRule-meta.xml", f"<ValidationRule {NS}><errorConditionFormula>AND(ISBLANK(Name), Amt{{s_suppkey}}__c &gt; 3)</errorConditionFormula></ValidationRule>")
    layouts = file_of(T.read(spark, d, "nation"), "layouts/Obj{n_nationkey}-Main.layout-meta.xml", f"<Layout {NS}><layoutSections><layoutColumns><layoutItems><field>R{{n_regionkey}}__c</field></layoutItems></layoutColumns></layoutSections></Layout>")
    return found(read_tree(fields, objects, rules, layouts))


FL = "'flow_fl' || s_suppkey"


@query(
    n(FL, "'Fl' || s_suppkey", "Flow", "flow", "supplier"),
    n("'flowelement_fl' || s_suppkey || '_dec'", "'Which?'", "FlowDecision", "flow", "supplier"),
    e(FL, "'object_obj' || s_nationkey", "triggers", "EXTRACTED", "supplier"),
    e(FL, "'apex_act' || s_suppkey", "calls", "EXTRACTED", "supplier"),
    e(FL, "'flow_sub' || s_nationkey", "invokes", "EXTRACTED", "supplier"),
    e(FL, "'object_read' || s_nationkey", "references", "EXTRACTED", "supplier"),
    e(FL, "'object_made' || s_nationkey", "references", "EXTRACTED", "supplier"),
    e(FL, "'flowelement_fl' || s_suppkey || '_dec'", "contains", "EXTRACTED", "supplier"),
    n("'workflow_obj' || n_nationkey", "'Obj' || n_nationkey || ' Workflow'", "Workflow", "automation", "nation"),
    n("'workflowrule_obj' || n_nationkey || '_r1'", "'R1'", "WorkflowRule", "automation", "nation"),
    n("'workflowfieldupdate_obj' || n_nationkey || '_u1'", "'U1'", "WorkflowFieldUpdate", "automation", "nation"),
    e("'workflow_obj' || n_nationkey", "'object_obj' || n_nationkey", "triggers", "EXTRACTED", "nation"),
    e("'workflow_obj' || n_nationkey", "'workflowrule_obj' || n_nationkey || '_r1'", "contains", "EXTRACTED", "nation"),
    e("'workflow_obj' || n_nationkey", "'workflowfieldupdate_obj' || n_nationkey || '_u1'", "contains", "EXTRACTED", "nation"),
    e("'workflowfieldupdate_obj' || n_nationkey || '_u1'", "'field_obj' || n_nationkey || '_f' || n_regionkey || '__c'", "references", "EXTRACTED", "nation"),
)
def extract_automation(spark, d):
    """Flows from suppliers, workflows from nations."""
    flows = file_of(
        T.read(spark, d, "supplier"),
        "flows/Fl{s_suppkey}.flow-meta.xml",
        f"<Flow {NS}><processType>AutoLaunchedFlow</processType><start><object>Obj{{s_nationkey}}</object><triggerType>RecordAfterSave</triggerType><recordTriggerType>Create</recordTriggerType></start><actionCalls><actionType>apex</actionType><actionName>Act{{s_suppkey}}</actionName></actionCalls><recordLookups><name>a</name><object>Read{{s_nationkey}}</object></recordLookups><recordLookups><name>b</name><object>Read{{s_nationkey}}</object></recordLookups><recordCreates><name>c</name><object>Made{{s_nationkey}}</object></recordCreates><subflows><flowName>Sub{{s_nationkey}}</flowName></subflows><decisions><name>Dec</name><label>Which?</label></decisions></Flow>",
    )
    workflows = file_of(T.read(spark, d, "nation"), "workflows/Obj{n_nationkey}.workflow-meta.xml", f"<Workflow {NS}><rules><fullName>R1</fullName></rules><fieldUpdates><fullName>U1</fullName><field>F{{n_regionkey}}__c</field></fieldUpdates></Workflow>")
    return found(read_tree(flows, workflows))


PS = "'permset_ps' || s_suppkey"


@query(
    n(PS, "'PS' || s_suppkey", "PermissionSet", "profile", "supplier"),
    n("'app_shop' || s_nationkey", "'Shop' || s_nationkey", "App", "profile", "supplier"),
    e(PS, "'object_obj' || s_nationkey", "grants", "EXTRACTED", "supplier"),
    e(PS, "'field_obj' || s_nationkey || '_f' || s_suppkey || '__c'", "grants", "EXTRACTED", "supplier"),
    e(PS, "'apex_cls' || s_suppkey", "grants", "EXTRACTED", "supplier"),
    e(PS, "'page_pg' || s_suppkey", "grants", "EXTRACTED", "supplier"),
    e(PS, "'app_shop' || s_nationkey", "grants", "EXTRACTED", "supplier"),
    n("'permset_grp' || n_nationkey", "'Grp' || n_nationkey", "PermissionSetGroup", "profile", "nation"),
    e("'permset_grp' || n_nationkey", "'permset_ps' || n_regionkey", "contains", "EXTRACTED", "nation"),
    n("'criteriasharingrule_obj' || n_nationkey || '_cr'", "'Obj' || n_nationkey || ': CR'", "CriteriaSharingRule", "sharing", "nation"),
    e("'criteriasharingrule_obj' || n_nationkey || '_cr'", "'object_obj' || n_nationkey", "references", "EXTRACTED", "nation"),
    e("'criteriasharingrule_obj' || n_nationkey || '_cr'", "'role_rl' || n_regionkey", "references", "EXTRACTED", "nation"),
)
def extract_security(spark, d):
    """Permission sets from suppliers, groups and sharing rules from nations."""
    sets = file_of(
        T.read(spark, d, "supplier"),
        "permissionsets/PS{s_suppkey}.permissionset-meta.xml",
        f"<PermissionSet {NS}><objectPermissions><object>Obj{{s_nationkey}}</object></objectPermissions><fieldPermissions><field>Obj{{s_nationkey}}.F{{s_suppkey}}__c</field></fieldPermissions><classAccesses><apexClass>Cls{{s_suppkey}}</apexClass></classAccesses><pageAccesses><apexPage>Pg{{s_suppkey}}</apexPage></pageAccesses><applicationVisibilities><application>Shop{{s_nationkey}}</application><visible>true</visible></applicationVisibilities><applicationVisibilities><application>Hidden</application><visible>false</visible></applicationVisibilities></PermissionSet>",
    )
    nation = T.read(spark, d, "nation")
    groups = file_of(nation, "permissionsetgroups/Grp{n_nationkey}.permissionsetgroup-meta.xml", f"<PermissionSetGroup {NS}><permissionSets>PS{{n_regionkey}}</permissionSets><mutedPermissions>M</mutedPermissions></PermissionSetGroup>")
    rules = file_of(nation, "sharingRules/Obj{n_nationkey}.sharingRules-meta.xml", f"<SharingRules {NS}><sharingCriteriaRules><fullName>CR</fullName><sharedTo><role>Rl{{n_regionkey}}</role></sharedTo></sharingCriteriaRules></SharingRules>")
    return found(read_tree(sets, groups, rules))


W = "'lwc_card' || p_partkey"


@query(
    n(W, "'card' || p_partkey", "LWCComponent", "lwc", "part"),
    n("'lwcmethod_card' || p_partkey || '_load'", "'card' || p_partkey || '.load()'", "LWCMethod", "lwc", "part"),
    e(W, "'method_svc' || p_size || '_get'", "calls", "EXTRACTED", "part"),
    e(W, "'object_obj' || p_size || '__c'", "references", "EXTRACTED", "part"),
    e(W, "'lwcmethod_card' || p_partkey || '_load'", "contains", "EXTRACTED", "part"),
    e(W, "'lwc_inneritem'", "uses", "EXTRACTED", "part"),
    n("'aura_old' || n_nationkey", "'old' || n_nationkey", "AuraComponent", "aura", "nation"),
    n("'auramethod_old' || n_nationkey || '_run'", "'old' || n_nationkey || '.run()'", "AuraControllerMethod", "aura", "nation"),
    e("'aura_old' || n_nationkey", "'apex_ctl' || n_regionkey", "references", "EXTRACTED", "nation"),
    e("'aura_old' || n_nationkey", "'auramethod_old' || n_nationkey || '_run'", "contains", "EXTRACTED", "nation"),
    e("'aura_old' || n_nationkey", "'method_ctl' || n_regionkey || '_save'", "calls", "INFERRED", "nation"),
    n("'page_pg' || s_suppkey", "'Pg' || s_suppkey", "ApexPage", "visualforce", "supplier"),
    e("'page_pg' || s_suppkey", "'object_obj' || s_nationkey || '__c'", "references", "EXTRACTED", "supplier"),
    e("'page_pg' || s_suppkey", "'apex_ext' || s_suppkey", "references", "EXTRACTED", "supplier"),
    e("'page_pg' || s_suppkey", "'vfcomponent_box'", "uses", "EXTRACTED", "supplier"),
)
def extract_bundles(spark, d):
    """Components from parts, whose script and markup are siblings; older ones from nations, pages from suppliers."""
    brace = lambda df: df.withColumn("content", F.translate(F.decode("content", "UTF-8"), "\x01\x02", "{}").cast("binary"))
    part, nation = T.read(spark, d, "part"), T.read(spark, d, "nation")
    js = brace(file_of(part, "lwc/card{p_partkey}/card{p_partkey}.js", "import get from '@salesforce/apex/Svc{p_size}.get';\nimport OBJ from '@salesforce/schema/Obj{p_size}__c';\nexport default class C extends LightningElement \x01\n  load() \x01\n  \x02\n\x02\n"))
    html = file_of(part, "lwc/card{p_partkey}/card{p_partkey}.html", "<template><c-inner-item></c-inner-item></template>")
    cmp = file_of(nation, "aura/old{n_nationkey}/old{n_nationkey}.cmp", '<aura:component controller="Ctl{n_regionkey}"></aura:component>')
    ctl = brace(file_of(nation, "aura/old{n_nationkey}/old{n_nationkey}Controller.js", '(\x01\n  run : function(cmp) \x01 cmp.get("c.save"); \x02\n\x02)'))
    page = file_of(T.read(spark, d, "supplier"), "pages/Pg{s_suppkey}.page", '<apex:page standardController="Obj{s_nationkey}__c" extensions="Ext{s_suppkey}"><c:Box/></apex:page>')
    return found(read_tree(js, html, cmp, ctl, page))


#: Kinds whose files are a node each: folder, suffix, start of the id, type, file type.
SIMPLE = (
    ("globalValueSets", "globalValueSet", "globalvalueset", "GlobalValueSet", "object"),
    ("customMetadata", "md", "custommetadata", "CustomMetadataRecord", "config"),
    ("namedCredentials", "namedCredential", "namedcredential", "NamedCredential", "config"),
    ("authproviders", "authprovider", "authprovider", "AuthProvider", "config"),
    ("staticresources", "resource", "staticresource", "StaticResource", "config"),
    ("sharingSets", "sharingSet", "sharingset", "SharingSet", "sharing"),
    ("remoteSiteSettings", "remoteSite", "remotesitesetting", "RemoteSiteSetting", "config"),
    ("cspTrustedSites", "cspTrustedSite", "csptrustedsite", "CspTrustedSite", "config"),
    ("corsWhitelistOrigins", "corsWhitelistOrigin", "corsorigin", "CorsOrigin", "config"),
    ("settings", "settings", "settings", "Settings", "config"),
    ("connectedApps", "connectedApp", "connectedapp", "ConnectedApp", "config"),
    ("testSuites", "testSuite", "apextestsuite", "ApexTestSuite", "config"),
    ("roles", "role", "userrole", "UserRole", "config"),
    ("sites", "site", "customsite", "CustomSite", "config"),
    ("networks", "network", "network", "Network", "config"),
)
#: Kinds with one link: folder, suffix, start of the id, type, file type, element, start of the target's id, relation.
LINKED = (
    ("externalServiceRegistrations", "externalService", "externalservice", "ExternalService", "config", "namedCredential", "namedcredential", "uses"),
    ("dataSources", "externalDataSource", "externaldatasource", "ExternalDataSource", "config", "namedCredential", "namedcredential", "uses"),
    ("quickActions", "quickAction", "quickaction", "QuickAction", "config", "targetObject", "object", "references"),
    ("tabs", "tab", "customtab", "CustomTab", "config", "customObject", "object", "references"),
    ("applications", "app", "customapplication", "CustomApplication", "config", "tabs", "customtab", "contains"),
    ("flexipages", "flexipage", "flexipage", "FlexiPage", "config", "sobjectType", "object", "record_page_for"),
    ("escalationRules", "escalationRules", "escalationrules", "EscalationRules", "automation", "sObjectType", "object", "references"),
    ("restrictionRules", "restrictionRule", "restrictionrule", "RestrictionRule", "rules", "targetEntity", "object", "references"),
)


@query(
    *[n(f"'{prefix}_n' || n_nationkey", "'N' || n_nationkey", t, ft, "nation") for _, _, prefix, t, ft in SIMPLE],
    *[n(f"'{x[2]}_n' || n_nationkey", "'N' || n_nationkey", x[3], x[4], "nation") for x in LINKED],
    *[e(f"'{x[2]}_n' || n_nationkey", f"'{x[6]}_to' || n_regionkey", x[7], "EXTRACTED", "nation") for x in LINKED],
)
def extract_configuration(spark, d):
    """A file a nation of each of the simple kinds."""
    nation = T.read(spark, d, "nation")
    simple = [file_of(nation, f"{folder}/N{{n_nationkey}}.{suffix}-meta.xml", f"<Root {NS}><label>x</label></Root>") for folder, suffix, *_ in SIMPLE]
    linked = [file_of(nation, f"{x[0]}/N{{n_nationkey}}.{x[1]}-meta.xml", f"<Root {NS}><{x[5]}>To{{n_regionkey}}</{x[5]}></Root>") for x in LINKED]
    return found(read_tree(*simple, *linked))


DOC = "'doc_d' || doc_id || '_' || substring(sha256('" + BASE + "docs/d' || doc_id || '.md'), 1, 8)"


@query(
    n(DOC, "'d' || doc_id || '.md'", "Document", "document", "documents"),
    n(f"{DOC} || '_h_guide_' || doc_id || '_2'", "'Guide ' || doc_id", "DocumentSection", "document", "documents"),
    n(f"{DOC} || '_h_more_4'", "'More'", "DocumentSection", "document", "documents"),
    e(DOC, f"{DOC} || '_h_guide_' || doc_id || '_2'", "contains", "EXTRACTED", "documents"),
    e(DOC, f"{DOC} || '_h_more_4'", "contains", "EXTRACTED", "documents"),
)
def extract_documents(spark, d):
    """A Markdown file a document: headings of three levels at most count, whatever its text is, on one line."""
    docs = T.read(spark, d, "documents").withColumn("line", F.regexp_replace(F.coalesce("text", F.lit("")), "[\\n\\r\\f\\x0B\\x1C-\\x1E\\x85\\x{2028}\\x{2029}#]", " "))
    return found(read_tree(file_of(docs, "docs/d{doc_id}.md", "{line}\n# Guide {doc_id}\n{line}\n### More\n#### deep\n")))
