"""Extractors of XML metadata, one declaration a kind: the struct that ``from_xml`` reads, and the nodes and edges it gives.

All of it is Catalyst: a kind's files are parsed once, in the JVM, into typed arrays, and nodes and edges are array
expressions over them. A malformed file gives the node that its path names, or nothing for kinds marked strict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.extract.fragments import both, each, edge, ident, node
from weftgraph.functions.text import make_id

CLASS, FLOW, OBJECT = "apex", "flow", "object"


@dataclass
class File:
    """Columns of one file: the parsed root, the whole text, its name without suffix, and folders above it."""

    x: Column
    text: Column
    name: Column
    base: Column
    parent: Column
    grand: Column

    def all(self, tag: str) -> Column:
        """Texts of elements of a name at any depth."""
        return F.transform(F.xpath("text", F.lit(f"//*[local-name()='{tag}']/text()")), lambda t: F.btrim(t, F.lit(" \t\r\n")))


@dataclass
class Kind:
    suffixes: tuple[str, ...]
    schema: str
    build: Callable[[File], tuple[Column, Column]]
    strict: bool = False


KINDS: dict[str, Kind] = {}


def kind(name: str, suffixes: str, schema: str = "", strict: bool = False):
    def add(fn):
        KINDS[name] = Kind(tuple(suffixes.split()), schema, fn, strict)
        return fn

    return add


def plain(name: str, suffixes: str, prefix: str, sf_type: str, file_type: str) -> None:
    """A kind whose files are a node each."""
    kind(name, suffixes)(lambda f: (F.array(node(make_id(F.lit(prefix), f.name), f.name, sf_type, file_type)), none()))


def none() -> Column:
    null = F.lit(None).cast("string")
    return F.filter(F.array(edge(null, null, null)), lambda e: F.lit(False))


def attr_node(name: str, suffixes: str, prefix: str, sf_type: str, schema: str, **fields: str) -> None:
    """A node with attributes read from the root: attribute = comma-separated elements, the first that is there."""

    def build(f: File):
        got = {k: F.coalesce(*[f.x[t] for t in v.split(",")]) for k, v in fields.items()}
        return F.array(node(make_id(F.lit(prefix), f.name), f.name, sf_type, "config", **got)), none()

    kind(name, suffixes, schema)(build)


@kind("flow", ".flow-meta.xml", "processType string, triggerType string, start struct<object:string,triggerType:string,recordTriggerType:string>, actionCalls array<struct<actionType:string,actionName:string,apexClass:string,inputParameters:array<struct<value:struct<stringValue:string>>>>>, recordLookups array<struct<object:string>>, recordCreates array<struct<object:string>>, recordUpdates array<struct<object:string>>, recordDeletes array<struct<object:string>>, subflows array<struct<flowName:string>>, decisions array<struct<name:string,label:string>>, loops array<struct<name:string,label:string>>, screens array<struct<name:string,label:string>>, assignments array<struct<name:string,label:string>>, collectionProcessors array<struct<name:string,label:string>>", strict=True)
def flow(f: File):
    x, me = f.x, make_id(F.lit("flow"), f.name)
    process = F.coalesce(x["processType"], F.lit("Flow"))
    start = x["start"]
    how = start["triggerType"]
    saved = how.isin("RecordAfterSave", "RecordBeforeSave", "RecordBeforeDelete")
    op = F.when(saved, F.concat_ws(":", how, start["recordTriggerType"])).when(how == "PlatformEvent", "platform_event").when(how == "Scheduled", "scheduled")
    fired = edge(me, F.when(op.isNotNull(), ident(OBJECT, start["object"])), "triggers", operation=op)

    def called(a):
        apex, sub = a["actionType"] == "apex", a["actionType"].isin("flow", "subflow")
        target = F.when(apex, ident(CLASS, F.coalesce(a["apexClass"], a["actionName"]))).when(sub, ident(FLOW, a["actionName"]))
        return edge(me, target, F.when(apex, "calls").otherwise("invokes"))

    def endpoint(v):
        named = F.regexp_extract(v, "(?i)^callout:([^/]+)", 1)
        host = F.lower(F.try_parse_url(v, F.lit("HOST")))
        target = F.when(named != "", make_id(F.lit("namedcredential"), named)).when(v.rlike("^https?://"), make_id(F.lit("externalendpoint"), F.coalesce(host, v)))
        return edge(me, target, "makes_callout", F.when(named != "", "EXTRACTED").otherwise("INFERRED"))

    values = F.flatten(each(x["actionCalls"], lambda a: F.coalesce(F.transform(a["inputParameters"], lambda p: p["value"]["stringValue"]), F.array().cast("array<string>"))))
    ops = [each(x[tag], lambda r, o=o: edge(me, ident(OBJECT, r["object"]), "references", operation=o)) for tag, o in (("recordLookups", "read"), ("recordCreates", "create"), ("recordUpdates", "update"), ("recordDeletes", "delete"))]
    parts = [("decisions", "FlowDecision"), ("loops", "FlowLoop"), ("screens", "FlowScreen"), ("assignments", "FlowAssignment"), ("collectionProcessors", "FlowCollectionProcessor")]
    inner = [each(x[t], lambda e, k=k: node(ident("flowelement", f.name, e["name"]), F.coalesce(e["label"], e["name"]), k, "flow")) for t, k in parts]
    held = [each(x[t], lambda e: edge(me, ident("flowelement", f.name, e["name"]), "contains")) for t, _ in parts]
    own = node(me, f.name, F.when(process == "Workflow", "ProcessBuilder").otherwise("Flow"), "flow", process_type=process, trigger_type=x["triggerType"])
    subs = each(x["subflows"], lambda s: edge(me, ident(FLOW, s["flowName"]), "invokes"))
    return both(F.array(own), *inner), both(F.array(fired), each(x["actionCalls"], called), each(values, endpoint), *ops, subs, *held)


@kind("object", ".object-meta.xml", "label string, description string, sharingModel string, externalSharingModel string, customSettingsType string, externalDataSource string")
def custom_object(f: File):
    x, me = f.x, make_id(F.lit(OBJECT), f.name)
    sf_type = F.when(f.name.endswith("__x"), "ExternalObject").when(f.name.endswith("__e"), "PlatformEvent").when(x["customSettingsType"] != "", "CustomSetting").otherwise("CustomObject")
    own = node(me, f.name, sf_type, "object", display_label=x["label"], description=F.substring(x["description"], 1, 200), sharing_model=x["sharingModel"], external_sharing_model=x["externalSharingModel"])
    return F.array(own), F.array(edge(me, F.when(f.name.endswith("__x"), ident("externaldatasource", x["externalDataSource"])), "backed_by"))


@kind("field", ".field-meta.xml", "type string, label string, referenceTo array<string>, valueSet array<struct<valueSetName:string>>")
def custom_field(f: File):
    x, me, obj = f.x, make_id(F.lit("field"), f.grand, f.name), make_id(F.lit(OBJECT), f.grand)
    own = node(me, F.concat_ws(".", f.grand, f.name), "CustomField", "object", field_type=x["type"], display_label=x["label"])
    points = x["type"].isin("Lookup", "MasterDetail", "Hierarchy", "ExternalLookup")
    refs = each(x["referenceTo"], lambda r: edge(me, F.when(points, ident(OBJECT, r)), F.when(x["type"] == "MasterDetail", "master_detail").otherwise("references")))
    return F.array(own), both(F.array(edge(obj, me, "contains")), refs, each(x["valueSet"], lambda v: edge(me, ident("globalvalueset", v["valueSetName"]), "uses")))


#: Names in formulas that are functions or literals, not fields.
FUNCTIONS = (
    "ABS ADDMONTHS AND BEGINS BLANKVALUE BR CASE CEILING CONTAINS DATE DATETIMEVALUE DATEVALUE DAY ELSE END EXCLUDES EXP FALSE FIND FLOOR GETRECORDIDS HOUR HYPERLINK IF IMAGE INCLUDES ISBLANK ISCHANGED "
    "ISNEW ISNULL ISPICKVAL LABEL LEFT LEN LN LOG LOWER MAX MID MIN MINUTE MOD MONTH MROUND NOT NOW NULL NULLVALUE OR PARENTGROUPVAL PREVGROUPVAL PRIORVALUE REGEX RIGHT ROUND SECOND SQRT SUBSTITUTE "
    "TEXT THEN TODAY TRIM TRUE UPPER VALUE VLOOKUP WEEKDAY WHEN YEAR"
).split()
CHILDREN = {"validationRule": "ValidationRule", "recordType": "RecordType", "listView": "ListView", "compactLayout": "CompactLayout", "webLink": "WebLink", "sharingReason": "SharingReason", "businessProcess": "BusinessProcess", "index": "Index"}


def formula_fields(formula: Column, obj: Column, me: Column) -> Column:
    """Fields that a formula names: custom ones, those of other objects, then standard ones where they are compared or inspected. The first pattern that finds a field decides."""
    custom = each(F.regexp_extract_all(formula, F.lit("(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_]*__[cr])(?![A-Za-z0-9_])"), 1), lambda n: F.struct(ident("field", obj, n).alias("t"), F.lit(0.7).alias("w")))
    cross = each(F.regexp_extract_all(formula, F.lit("(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]+[.][A-Za-z][A-Za-z0-9_]*__[cr])(?![A-Za-z0-9_])"), 1), lambda n: F.struct(ident("field", F.split_part(n, F.lit("."), F.lit(1)), F.split_part(n, F.lit("."), F.lit(2))).alias("t"), F.lit(0.7).alias("w")))
    compared = F.regexp_extract_all(formula, F.lit("(?<![A-Za-z0-9_.])([A-Z][A-Za-z0-9_]*)\\s*(?:[!<>]=?|==?)"), 1)
    inspected = F.regexp_extract_all(formula, F.lit("(?i)(?<![a-z0-9_])(?:is(?:blank|null|pickval|changed)|priorvalue)\\s*\\(\\s*(?-i:([A-Z][A-Za-z0-9_]*))"), 1)
    bare = F.filter(F.concat(compared, inspected), lambda n: ~F.upper(n).isin(*FUNCTIONS) & ~n.rlike("__[crxe]$"))
    found = F.concat(custom, cross, each(bare, lambda n: F.struct(ident("field", obj, n).alias("t"), F.lit(0.5).alias("w"))))
    targets = F.array_distinct(F.transform(found, lambda s: s["t"]))
    weight = lambda t: F.element_at(F.filter(found, lambda s: s["t"] == t), 1)["w"]
    return each(targets, lambda t: edge(me, t, "references", "INFERRED").withField("weight", weight(t)))


@kind("object_child", " ".join(f".{k}-meta.xml" for k in CHILDREN), "fields array<string>, columns array<string>, businessProcess string, errorConditionFormula string")
def object_child(f: File):
    x, what = f.x, F.regexp_extract(f.base, "\\.([A-Za-z]+)-meta\\.xml$", 1)
    sf_type = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in CHILDREN.items() for v in kv]), what), F.lit("ObjectChild"))
    me = make_id(F.lower(sf_type), f.grand, f.name)
    used = [each(x[tag], lambda n, k=k: edge(me, F.when(sf_type == k, ident("field", f.grand, n)), "uses")) for tag, k in (("fields", "CompactLayout"), ("columns", "ListView"))]
    process = F.array(edge(me, F.when(sf_type == "RecordType", ident("businessprocess", f.grand, x["businessProcess"])), "references"))
    formula = formula_fields(F.when(sf_type == "ValidationRule", x["errorConditionFormula"]), f.grand, me)
    return F.array(node(me, F.concat_ws(": ", f.grand, f.name), sf_type, "object")), both(F.array(edge(make_id(F.lit(OBJECT), f.grand), me, "contains")), *used, process, formula)


@kind("field_set", ".fieldSet-meta.xml", "displayedFields array<struct<field:string>>, availableFields array<struct<field:string>>")
def field_set(f: File):
    me = make_id(F.lit("fieldset"), f.grand, f.name)
    held = [each(f.x[t], lambda e: edge(me, ident("field", f.grand, e["field"]), "contains")) for t in ("displayedFields", "availableFields")]
    return F.array(node(me, F.concat_ws(": ", f.grand, f.name), "FieldSet", "object")), both(F.array(edge(make_id(F.lit(OBJECT), f.grand), me, "contains")), *held)


@kind("layout", ".layout-meta.xml", "layoutSections array<struct<layoutColumns:array<struct<layoutItems:array<struct<field:string>>>>>>")
def layout(f: File):
    me, obj = make_id(F.lit("layout"), f.name), F.split_part(f.name, F.lit("-"), F.lit(1))
    columns = F.flatten(each(f.x["layoutSections"], lambda s: F.coalesce(s["layoutColumns"], F.array())))
    fields = F.flatten(each(columns, lambda c: F.coalesce(F.transform(c["layoutItems"], lambda i: i["field"]), F.array())))
    return F.array(node(me, f.name, "Layout", "layout")), both(F.array(edge(me, make_id(F.lit(OBJECT), obj), "references")), each(fields, lambda n: edge(me, ident("field", obj, n), "uses", weight=0.5)))


GRANTS = "objectPermissions array<struct<object:string,objectApiName:string>>, fieldPermissions array<struct<field:string>>, classAccesses array<struct<apexClass:string>>, pageAccesses array<struct<apexPage:string>>, tabVisibilities array<struct<tab:string>>, tabSettings array<struct<tab:string>>, userPermissions array<struct<name:string,enabled:string>>, applicationVisibilities array<struct<application:string,visible:string>>"


def granted(f: File, me: Column) -> tuple[Column, Column, Column]:
    """Nodes of tabs and applications, the grants, and the user permissions that are on."""
    x, true = f.x, lambda c: F.lower(c) == "true"
    seen = each(F.filter(x["applicationVisibilities"], lambda a: true(a["visible"])), lambda a: a["application"])
    tabs = each(x["tabVisibilities"], lambda t: t["tab"])
    nodes = both(each(tabs, lambda t: node(ident("customtab", t), t, "CustomTab", "profile")), each(seen, lambda a: node(ident("app", a), a, "App", "profile")))
    edges = both(
        each(x["objectPermissions"], lambda p: edge(me, ident(OBJECT, F.coalesce(p["object"], p["objectApiName"])), "grants", weight=0.5)),
        each(x["fieldPermissions"], lambda p: edge(me, F.when(p["field"].contains("."), ident("field", F.regexp_extract(p["field"], "^([^.]*)", 1), F.regexp_extract(p["field"], "^[^.]*\\.(.*)$", 1))), "grants", weight=0.3)),
        each(x["classAccesses"], lambda p: edge(me, ident(CLASS, p["apexClass"]), "grants", weight=0.5)),
        each(x["pageAccesses"], lambda p: edge(me, ident("page", p["apexPage"]), "grants", weight=0.5)),
        each(tabs, lambda t: edge(me, ident("customtab", t), "grants", weight=0.5)),
        each(seen, lambda a: edge(me, ident("app", a), "grants", weight=0.5)),
    )
    on = F.array_join(F.transform(F.filter(x["userPermissions"], lambda p: true(p["enabled"])), lambda p: p["name"]), ",")
    return nodes, edges, on


def permissions(name: str, suffix: str, prefix: str, sf_type: str) -> None:
    def build(f: File):
        me = make_id(F.lit(prefix), f.name)
        nodes, edges, on = granted(f, me)
        return both(F.array(node(me, f.name, sf_type, "profile", user_permissions=on)), nodes), edges

    kind(name, suffix, GRANTS)(build)


permissions("profile", ".profile-meta.xml", "profile", "Profile")
permissions("permset", ".permissionset-meta.xml", "permset", "PermissionSet")


@kind("permset_group", ".permissionsetgroup-meta.xml", GRANTS + ", permissionSets array<string>, mutedPermissions array<string>")
def permset_group(f: File):
    me = make_id(F.lit("permset"), f.name)
    _, edges, on = granted(f, me)
    own = node(me, f.name, "PermissionSetGroup", "profile", user_permissions=on, muted_permission_sets=F.array_join(f.x["mutedPermissions"], ","))
    return F.array(own), both(edges, each(f.x["permissionSets"], lambda p: edge(me, ident("permset", p), "contains")))


@kind("workflow", ".workflow-meta.xml", "rules array<struct<fullName:string>>, alerts array<struct<fullName:string>>, fieldUpdates array<struct<fullName:string,field:string>>, tasks array<struct<fullName:string>>, outboundMessages array<struct<fullName:string,endpointUrl:string>>")
def workflow(f: File):
    x, me = f.x, make_id(F.lit("workflow"), f.name)
    parts = [("rules", "workflowrule", "WorkflowRule"), ("alerts", "workflowalert", "WorkflowAlert"), ("fieldUpdates", "workflowfieldupdate", "WorkflowFieldUpdate"), ("tasks", "workflowtask", "WorkflowTask"), ("outboundMessages", "workflowoutboundmessage", "WorkflowOutboundMessage")]
    inner = [each(x[t], lambda e, p=p, k=k, t=t: node(ident(p, f.name, e["fullName"]), e["fullName"], k, "automation", **({"endpoint_url": e["endpointUrl"]} if t == "outboundMessages" else {}))) for t, p, k in parts]
    held = [each(x[t], lambda e, p=p: edge(me, ident(p, f.name, e["fullName"]), "contains")) for t, p, _ in parts]
    set_ = each(x["fieldUpdates"], lambda e: edge(ident("workflowfieldupdate", f.name, e["fullName"]), ident("field", f.name, F.element_at(F.split(e["field"], "\\."), -1)), "references"))
    return both(F.array(node(me, F.concat(f.name, F.lit(" Workflow")), "Workflow", "automation")), *inner), both(F.array(edge(me, make_id(F.lit(OBJECT), f.name), "triggers")), *held, set_)


@kind("approval", ".approvalProcess-meta.xml", "object string, initialSubmissionActions array<struct<type:string,apexClass:string,action:array<struct<type:string,apexClass:string>>>>")
def approval(f: File):
    me = make_id(F.lit("approvalprocess"), f.name)
    steps = each(f.x["initialSubmissionActions"], lambda a: edge(me, F.when(a["type"] == "ApexApproval", ident(CLASS, a["apexClass"])), "calls"))
    return F.array(node(me, f.name, "ApprovalProcess", "automation")), both(F.array(edge(me, ident(OBJECT, f.x["object"]), "references")), steps)


@kind("automation", ".escalationRules-meta.xml .assignmentRules-meta.xml .autoResponseRules-meta.xml", "sObjectType string, object string")
def automation(f: File):
    sf_type = F.initcap(F.regexp_extract(f.base, "\\.([A-Za-z]+)-meta\\.xml$", 1))
    sf_type = F.when(sf_type == "Escalationrules", "EscalationRules").when(sf_type == "Assignmentrules", "AssignmentRules").otherwise("AutoResponseRules")
    me = make_id(F.lower(sf_type), f.name)
    return F.array(node(me, f.name, sf_type, "automation")), F.array(edge(me, ident(OBJECT, F.coalesce(f.x["sObjectType"], f.x["object"])), "references"))


@kind("labels", ".labels-meta.xml", "labels array<struct<fullName:string,shortDescription:string>>")
def labels(f: File):
    return each(f.x["labels"], lambda e: node(ident("label", e["fullName"]), e["fullName"], "CustomLabel", "config", description=F.substring(e["shortDescription"], 1, 200))), none()


plain("value_set", ".globalValueSet-meta.xml", "globalvalueset", "GlobalValueSet", "object")
plain("metadata_record", ".md-meta.xml", "custommetadata", "CustomMetadataRecord", "config")
plain("named_credential", ".namedCredential-meta.xml", "namedcredential", "NamedCredential", "config")
plain("auth_provider", ".authprovider-meta.xml", "authprovider", "AuthProvider", "config")
plain("static_resource", ".resource-meta.xml", "staticresource", "StaticResource", "config")
plain("sharing_set", ".sharingSet-meta.xml", "sharingset", "SharingSet", "sharing")
attr_node("remote_site", ".remoteSite-meta.xml .remoteSiteSetting-meta.xml", "remotesitesetting", "RemoteSiteSetting", "url string", endpoint_url="url")
attr_node("csp_site", ".cspTrustedSite-meta.xml", "csptrustedsite", "CspTrustedSite", "endpointUrl string, url string", endpoint_url="endpointUrl,url")
attr_node("cors_origin", ".corsWhitelistOrigins-meta.xml .corsWhitelistOrigin-meta.xml", "corsorigin", "CorsOrigin", "urlPattern string", url_pattern="urlPattern")


def linked(name: str, suffixes: str, prefix: str, sf_type: str, file_type: str, *links: tuple[str, str, str]) -> None:
    """A node with edges to what elements of the root name: (element, prefix of the target, relation)."""

    def build(f: File):
        me = make_id(F.lit(prefix), f.name)
        return F.array(node(me, f.name, sf_type, file_type)), F.array(*[edge(me, ident(p, f.x[t]), r) for t, p, r in links])

    kind(name, suffixes, ", ".join(f"{t} string" for t, _, _ in links))(build)


linked("external_service", ".externalService-meta.xml .externalServiceRegistration-meta.xml", "externalservice", "ExternalService", "config", ("namedCredential", "namedcredential", "uses"))
linked("data_source", ".externalDataSource-meta.xml .dataSource-meta.xml", "externaldatasource", "ExternalDataSource", "config", ("namedCredential", "namedcredential", "uses"))
linked("quick_action", ".quickAction-meta.xml", "quickaction", "QuickAction", "config", ("targetObject", OBJECT, "references"), ("lightningComponent", "lwc", "uses"), ("page", "page", "uses"))
linked("tab", ".tab-meta.xml", "customtab", "CustomTab", "config", ("customObject", OBJECT, "references"), ("flexiPage", "flexipage", "references"))


@kind("app", ".app-meta.xml", "tabs array<string>")
def app(f: File):
    me = make_id(F.lit("customapplication"), f.name)
    return F.array(node(me, f.name, "CustomApplication", "config")), each(f.x["tabs"], lambda t: edge(me, ident("customtab", t), "contains"))


@kind("flexipage", ".flexipage-meta.xml", "sobjectType string")
def flexipage(f: File):
    me = make_id(F.lit("flexipage"), f.name)

    def used(c):
        inner = F.substr(c, F.lit(3))
        aura = c.rlike("^c:[A-Z]")
        target = F.when(c.startswith("c__"), ident("lwc", F.replace(F.substr(c, F.lit(4)), F.lit("__"), F.lit("_")))).when(aura, ident("aura", inner)).when(c.startswith("c:"), ident("lwc", inner))
        return edge(me, target, "contains", F.when(aura, "EXTRACTED").otherwise("INFERRED")).withField("weight", F.when(aura, 1.0).otherwise(0.7))

    return F.array(node(me, f.name, "FlexiPage", "config")), both(F.array(edge(me, ident(OBJECT, f.x["sobjectType"]), "record_page_for")), each(F.array_distinct(f.all("componentName")), used))


CONFIGS = {"settings": "Settings", "connectedApp": "ConnectedApp", "testSuite": "ApexTestSuite", "role": "UserRole", "site": "CustomSite", "network": "Network", "group": "Config", "queue": "Config"}


@kind("config", " ".join(f".{k}-meta.xml" for k in CONFIGS))
def config(f: File):
    what = F.regexp_extract(f.base, "\\.([A-Za-z]+)-meta\\.xml$", 1)
    sf_type = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in CONFIGS.items() for v in kv]), what), F.lit("Config"))
    return F.array(node(make_id(F.lower(sf_type), f.name), f.name, sf_type, "config")), none()


SHARED = "array<struct<fullName:string,label:string,sharedTo:struct<group:array<string>,role:array<string>,roleAndSubordinates:array<string>,queue:array<string>>>>"
SHARING = {"sharingCriteriaRules": "CriteriaSharingRule", "sharingOwnerRules": "OwnerSharingRule", "sharingGuestRules": "GuestSharingRule", "sharingTerritoryRules": "TerritorySharingRule"}


@kind("sharing_rules", ".sharingRules-meta.xml", ", ".join(f"{t} {SHARED}" for t in SHARING))
def sharing_rules(f: File):
    nodes, edges = [], []
    for tag, sf_type in SHARING.items():
        me = lambda r, k=sf_type: ident(k.lower(), f.name, F.coalesce(r["fullName"], r["label"]))
        nodes.append(each(f.x[tag], lambda r, me=me, k=sf_type: node(me(r), F.concat_ws(": ", f.name, F.coalesce(r["fullName"], r["label"])), k, "sharing")))
        edges.append(each(f.x[tag], lambda r, me=me: edge(me(r), make_id(F.lit(OBJECT), f.name), "references")))
        for who in ("group", "role", "roleAndSubordinates", "queue"):
            edges.append(F.flatten(each(f.x[tag], lambda r, me=me, who=who: each(r["sharedTo"][who], lambda v: edge(me(r), ident(who.lower(), v), "references")))))
    return both(*nodes), both(*edges)


@kind("restriction_rule", ".restrictionRule-meta.xml .rule-meta.xml", "targetEntity string")
def restriction_rule(f: File):
    me = make_id(F.lit("restrictionrule"), f.name)
    return F.array(node(me, f.name, "RestrictionRule", "rules")), F.array(edge(me, make_id(F.lit(OBJECT), F.coalesce(f.x["targetEntity"], f.name)), "references"))


@kind("duplicate_rule", ".duplicateRule-meta.xml", "sobjectType string, duplicateRuleMatchingRules array<struct<matchingRule:string>>, matchingRules array<string>")
def duplicate_rule(f: File):
    me, obj = make_id(F.lit("duplicaterule"), f.name), F.coalesce(f.x["sobjectType"], F.split_part(f.name, F.lit("."), F.lit(1)))
    rules = both(each(f.x["duplicateRuleMatchingRules"], lambda r: edge(me, ident("matchingrule", r["matchingRule"]), "references")), each(f.x["matchingRules"], lambda r: edge(me, ident("matchingrule", r), "references")))
    return F.array(node(me, f.name, "DuplicateRule", "rules")), both(F.array(edge(me, make_id(F.lit(OBJECT), obj), "references")), rules)


@kind("matching_rule", ".matchingRule-meta.xml", "matchingRules array<struct<fullName:string>>")
def matching_rule(f: File):
    full = lambda r: F.concat_ws(".", f.name, r["fullName"])
    rules = each(f.x["matchingRules"], lambda r: node(F.when(r["fullName"].isNotNull(), make_id(F.lit("matchingrule"), full(r))), full(r), "MatchingRule", "rules"))
    return F.when(F.size(rules) > 0, rules).otherwise(F.array(node(make_id(F.lit("matchingrule"), f.name), f.name, "MatchingRule", "rules"))), none()


@kind("report", ".report-meta.xml", "reportType string, columns array<struct<field:string>>, groupingsDown array<struct<field:string>>, groupingsAcross array<struct<field:string>>, filter struct<criteriaItems:array<struct<column:string>>>")
def report(f: File):
    x, me = f.x, make_id(F.lit("report"), f.name)

    def used(n):
        dotted = n.contains(".")
        target = F.when(dotted, ident("field", F.regexp_extract(n, "^([^.]*)", 1), F.regexp_extract(n, "^[^.]*\\.(.*)$", 1))).otherwise(F.when(x["reportType"].isNotNull(), ident("field", x["reportType"], n)))
        return edge(me, target, "uses", F.when(dotted, "EXTRACTED").otherwise("INFERRED"))

    fields = [each(x[t], lambda c: used(c["field"])) for t in ("columns", "groupingsDown", "groupingsAcross")]
    return F.array(node(me, f.name, "Report", "reporting")), both(F.array(edge(me, ident("reporttype", x["reportType"]), "references")), *fields, each(x["filter"]["criteriaItems"], lambda c: used(c["column"])))


@kind("dashboard", ".dashboard-meta.xml", "title string")
def dashboard(f: File):
    me = make_id(F.lit("dashboard"), f.name)
    return F.array(node(me, f.name, "Dashboard", "reporting")), each(f.all("report"), lambda r: edge(me, ident("report", F.element_at(F.split(r, "/"), -1)), "uses"))


@kind("report_type", ".reportType-meta.xml", "baseObject string, sections array<struct<columns:array<struct<field:string>>>>")
def report_type(f: File):
    me, base = make_id(F.lit("reporttype"), f.name), f.x["baseObject"]
    columns = F.flatten(each(f.x["sections"], lambda s: F.coalesce(s["columns"], F.array())))
    return F.array(node(me, f.name, "ReportType", "reporting")), both(F.array(edge(me, ident(OBJECT, base), "references")), each(columns, lambda c: edge(me, F.when(base.isNotNull(), ident("field", base, c["field"])), "uses")))


@kind("package", ".installedPackage-meta.xml", "versionNumber string, namespace string")
def package(f: File):
    return F.array(node(make_id(F.lit("installedpackage"), f.name), f.name, "InstalledPackage", "packaging", version=f.x["versionNumber"], namespace=f.x["namespace"])), none()


@kind("bot", ".bot-meta.xml", "label string, description string, botUser string", strict=True)
def bot(f: File):
    return F.array(node(make_id(F.lit("bot"), f.name), F.coalesce(f.x["label"], f.name), "Bot", "agentforce", description=f.x["description"], bot_user=f.x["botUser"])), none()


@kind("bot_version", ".botVersion-meta.xml", "label string, description string, agentType string, conversationDefinition string, genAiPlugins array<struct<genAiPlugin:string>>, planner array<struct<genAiPlannerBundle:string>>, conversationDefinitionPlanners array<struct<genAiPlannerName:string>>", strict=True)
def bot_version(f: File):
    x, me = f.x, make_id(F.lit("botversion"), f.parent, f.name)
    own = node(me, F.coalesce(x["label"], F.concat_ws(" ", f.parent, f.name)), "BotVersion", "agentforce", description=x["description"], agent_type=x["agentType"])
    planners = both(each(x["planner"], lambda p: edge(me, ident("genaiplanner", p["genAiPlannerBundle"]), "references")), each(x["conversationDefinitionPlanners"], lambda p: edge(me, ident("genaiplanner", p["genAiPlannerName"]), "references")))
    return F.array(own), both(F.array(edge(make_id(F.lit("bot"), f.parent), me, "contains"), edge(me, ident(FLOW, x["conversationDefinition"]), "invokes")), each(x["genAiPlugins"], lambda p: edge(me, ident("genaiplugin", p["genAiPlugin"]), "references")), planners)


@kind("plugin", ".genAiPlugin-meta.xml", "masterLabel string, description string, pluginType string, functions array<struct<functionName:string>>, genAiFunctions array<struct<functionName:string>>", strict=True)
def plugin(f: File):
    x, me = f.x, make_id(F.lit("genaiplugin"), f.name)
    own = node(me, F.coalesce(x["masterLabel"], f.name), "GenAiPlugin", "agentforce", description=x["description"], plugin_type=x["pluginType"])
    return F.array(own), each(x["functions"], lambda n: edge(me, ident("genaifunction", n["functionName"]), "contains"))


@kind("function", ".genAiFunction-meta.xml", "masterLabel string, description string, invocableActionType string, invocableActionName string", strict=True)
def function(f: File):
    x, me = f.x, make_id(F.lit("genaifunction"), f.name)
    how = F.coalesce(x["invocableActionType"], F.lit(""))
    is_flow, known = how.isin("flow", "Flow"), how.isin("flow", "Flow", "apex", "apexAction")
    target = F.when(is_flow, ident(FLOW, x["invocableActionName"])).otherwise(ident(CLASS, x["invocableActionName"]))
    own = node(me, F.coalesce(x["masterLabel"], f.name), "GenAiFunction", "agentforce", description=x["description"], action_type=how)
    return F.array(own), F.array(edge(me, target, "invokes", F.when(known, "EXTRACTED").otherwise("INFERRED")))


@kind("planner", ".genAiPlannerBundle-meta.xml .genAiPlannerBundle", "masterLabel string, description string, plannerType string, subAgentDefinitions array<struct<genAiPlugin:string>>, localTopics array<struct<localActions:array<struct<fullName:string,masterLabel:string,invocationTarget:string,invocationTargetType:string>>>>", strict=True)
def planner(f: File):
    x, me = f.x, make_id(F.lit("genaiplanner"), f.name)
    own = node(me, F.coalesce(x["masterLabel"], f.name), "GenAiPlannerBundle", "agentforce", description=x["description"], planner_type=x["plannerType"])
    actions = F.filter(F.flatten(each(x["localTopics"], lambda t: F.coalesce(t["localActions"], F.array()))), lambda a: a["fullName"].isNotNull() & a["invocationTarget"].isNotNull())
    local = lambda a: ident("genaifunction_local", f.name, a["fullName"])

    def invoked(a):
        how = F.lower(F.coalesce(a["invocationTargetType"], F.lit("")))
        known = how.isin("flow", "apex", "apexaction")
        return edge(local(a), F.when(how == "flow", ident(FLOW, a["invocationTarget"])).when(known, ident(CLASS, a["invocationTarget"])).otherwise(ident("unknown", a["invocationTarget"])), "invokes", F.when(known, "EXTRACTED").otherwise("INFERRED"))

    inner = each(actions, lambda a: node(local(a), F.coalesce(a["masterLabel"], a["fullName"]), "GenAiFunction", "agentforce", scope="local", action_type=a["invocationTargetType"], parent_planner=f.name))
    return both(F.array(own), inner), both(each(x["subAgentDefinitions"], lambda s: edge(me, ident("genaiplugin", s["genAiPlugin"]), "references")), each(actions, lambda a: edge(me, local(a), "contains")), each(actions, invoked))


@kind("authoring", ".aiAuthoringBundle-meta.xml", "masterLabel string, bot string, botVersion string", strict=True)
def authoring(f: File):
    x, me = f.x, make_id(F.lit("aiauthoringbundle"), f.name)
    version = F.when(x["bot"].isNotNull(), ident("botversion", x["bot"], x["botVersion"]))
    return F.array(node(me, F.coalesce(x["masterLabel"], f.name), "AiAuthoringBundle", "agentforce")), F.array(edge(me, ident("bot", x["bot"]), "references"), edge(me, version, "references"))


@kind("prompt_template", ".promptTemplate-meta.xml .genAiPromptTemplate-meta.xml", "masterLabel string, promptTemplateType string, description string, primaryObject string, flexTemplateActionCalls array<struct<actionType:string,actionName:string>>", strict=True)
def prompt_template(f: File):
    x, me = f.x, make_id(F.lit("prompttemplate"), f.name)
    own = node(me, F.coalesce(x["masterLabel"], f.name), "PromptTemplate", "agentforce", template_type=x["promptTemplateType"], description=x["description"])
    calls = each(x["flexTemplateActionCalls"], lambda a: edge(me, F.when(a["actionType"] == "apex", ident(CLASS, a["actionName"])).when(a["actionType"].isin("flow", "Flow"), ident(FLOW, a["actionName"])), "references"))
    return F.array(own), both(F.array(edge(me, ident(OBJECT, x["primaryObject"]), "references")), each(F.array_distinct(f.all("relatedObject")), lambda o: edge(me, ident(OBJECT, o), "references")), calls)
