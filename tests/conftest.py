import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftgraph.session import session

    s = session("local[8]", spark__sql__shuffle__partitions="8", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


def xml(root: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<{root} xmlns="http://soap.sforce.com/2006/04/metadata">{body}</{root}>'


FILES = {
    "classes/OrderService.cls": """public with sharing class OrderService extends BaseService implements Sorter<Account, String>, Runnable {
    // insert ghost; Phantom.call();
    /* update other; { */
    public void save(List<Order__c> orders) {
        String s = 'delete orders; } Fake.run()';
        insert orders;
        Helper.log(s);
        Helper.missing(s);
    }
    public static Integer count(Id key) {
        Account orders = [SELECT Id FROM Account WHERE Id = :key];
        update orders;
        Unknown.thing();
        Flow.Interview.Approve_Order f;
        req.setEndpoint('callout:Billing/v1');
        req.setEndpoint('https://API.example.com/x');
        EventBus.publish(new Shipped__e());
        Rates__mdt.getInstance('a');
        Config__c.getOrgDefaults();
        return 1;
    }
}""",
    "classes/Helper.cls": "public class Helper {\n  public static void log(String s) {\n    System.debug(s);\n  }\n}",
    "classes/Sorter.cls": "public interface Sorter {}",
    "classes/broken.cls": "not a class at all",
    "triggers/OrderTrigger.trigger": "trigger OrderTrigger on Order__c (before insert, after update) {\n  Helper.log('x');\n}",
    "triggers/Shipped.trigger": "trigger Shipped on Shipped__e (after insert) { }",
    "flows/Approve_Order.flow-meta.xml": xml("Flow", "<processType>AutoLaunchedFlow</processType><start><object>Order__c</object><triggerType>RecordAfterSave</triggerType><recordTriggerType>Create</recordTriggerType></start><actionCalls><actionType>apex</actionType><actionName>OrderService</actionName><inputParameters><value><stringValue>callout:Billing/z</stringValue></value></inputParameters></actionCalls><recordLookups><object>Account</object></recordLookups><recordLookups><object>Account</object></recordLookups><recordUpdates><object>Account</object></recordUpdates><subflows><flowName>Notify</flowName></subflows><decisions><name>Big</name><label>Is big</label></decisions>"),
    "flows/Legacy.flow-meta.xml": xml("Flow", "<processType>Workflow</processType>"),
    "flows/Bad.flow-meta.xml": "<Flow><unclosed>",
    "objects/Order__c/Order__c.object-meta.xml": xml("CustomObject", "<label>Order</label><sharingModel>Private</sharingModel>"),
    "objects/Rates__x/Rates__x.object-meta.xml": xml("CustomObject", "<externalDataSource>Bank</externalDataSource>"),
    "objects/Config__c/Config__c.object-meta.xml": xml("CustomObject", "<customSettingsType>List</customSettingsType>"),
    "objects/Shipped__e/Shipped__e.object-meta.xml": xml("CustomObject", "<label>Shipped</label>"),
    "objects/Order__c/fields/Buyer__c.field-meta.xml": xml("CustomField", "<type>Lookup</type><referenceTo>Account</referenceTo><referenceTo>Order__c</referenceTo>"),
    "objects/Order__c/fields/Status__c.field-meta.xml": xml("CustomField", "<type>Picklist</type><valueSet><valueSetName>Stages</valueSetName></valueSet>"),
    "objects/Order__c/validationRules/Sane.validationRule-meta.xml": xml("ValidationRule", "<errorConditionFormula>AND(ISBLANK(Amount__c), Total &lt; 5, Account.Rank__c = 1, ISNULL(Owner), TEXT(x) = 'a')</errorConditionFormula>"),
    "objects/Order__c/listViews/All.listView-meta.xml": xml("ListView", "<columns>Status__c</columns><columns>Buyer__c</columns>"),
    "objects/Order__c/recordTypes/Web.recordType-meta.xml": xml("RecordType", "<businessProcess>Sale</businessProcess>"),
    "objects/Order__c/compactLayouts/Short.compactLayout-meta.xml": xml("CompactLayout", "<fields>Status__c</fields>"),
    "objects/Order__c/fieldSets/Main.fieldSet-meta.xml": xml("FieldSet", "<displayedFields><field>Status__c</field></displayedFields><availableFields><field>Status__c</field></availableFields><availableFields><field>Buyer__c</field></availableFields>"),
    "globalValueSets/Stages.globalValueSet-meta.xml": xml("GlobalValueSet", ""),
    "layouts/Order__c-Main Layout.layout-meta.xml": xml("Layout", "<layoutSections><layoutColumns><layoutItems><field>Status__c</field></layoutItems></layoutColumns></layoutSections>"),
    "profiles/Admin.profile-meta.xml": xml("Profile", "<objectPermissions><object>Order__c</object></objectPermissions><fieldPermissions><field>Order__c.Status__c</field></fieldPermissions><classAccesses><apexClass>OrderService</apexClass></classAccesses><tabVisibilities><tab>Orders</tab></tabVisibilities><applicationVisibilities><application>Shop</application><visible>true</visible></applicationVisibilities><applicationVisibilities><application>Hidden</application><visible>false</visible></applicationVisibilities><userPermissions><name>ApiEnabled</name><enabled>true</enabled></userPermissions><userPermissions><name>Off</name><enabled>false</enabled></userPermissions>"),
    "permissionsets/Clerk.permissionset-meta.xml": xml("PermissionSet", "<pageAccesses><apexPage>Orders</apexPage></pageAccesses>"),
    "permissionsetgroups/All.permissionsetgroup-meta.xml": xml("PermissionSetGroup", "<permissionSets>Clerk</permissionSets><mutedPermissions>Quiet</mutedPermissions>"),
    "workflows/Order__c.workflow-meta.xml": xml("Workflow", "<rules><fullName>R1</fullName></rules><alerts><fullName>A1</fullName></alerts><fieldUpdates><fullName>F1</fullName><field>Order__c.Status__c</field></fieldUpdates><tasks><fullName>T1</fullName></tasks><outboundMessages><fullName>O1</fullName><endpointUrl>https://out.example</endpointUrl></outboundMessages>"),
    "approvalProcesses/Order__c.Big.approvalProcess-meta.xml": xml("ApprovalProcess", "<object>Order__c</object><initialSubmissionActions><type>ApexApproval</type><apexClass>Helper</apexClass></initialSubmissionActions>"),
    "escalationRules/Case.escalationRules-meta.xml": xml("EscalationRules", "<sObjectType>Case</sObjectType>"),
    "labels/CustomLabels.labels-meta.xml": xml("CustomLabels", "<labels><fullName>Hello</fullName><shortDescription>says hello</shortDescription></labels><labels><fullName>Bye</fullName></labels>"),
    "namedCredentials/Billing.namedCredential-meta.xml": xml("NamedCredential", ""),
    "externalServices/Bank.externalService-meta.xml": xml("ExternalService", "<namedCredential>Billing</namedCredential>"),
    "flexipages/Home.flexipage-meta.xml": xml("FlexiPage", "<sobjectType>Order__c</sobjectType><flexiPageRegions><itemInstances><componentInstance><componentName>c:orderCard</componentName></componentInstance></itemInstances><itemInstances><componentInstance><componentName>c:OldCard</componentName></componentInstance></itemInstances></flexiPageRegions>"),
    "remoteSiteSettings/Out.remoteSite-meta.xml": xml("RemoteSiteSetting", "<url>https://out.example</url>"),
    "cspTrustedSites/Cdn.cspTrustedSite-meta.xml": xml("CspTrustedSite", "<endpointUrl>https://cdn.example</endpointUrl>"),
    "quickActions/New.quickAction-meta.xml": xml("QuickAction", "<targetObject>Order__c</targetObject><lightningComponent>orderCard</lightningComponent>"),
    "tabs/Orders.tab-meta.xml": xml("CustomTab", "<flexiPage>Home</flexiPage>"),
    "applications/Shop.app-meta.xml": xml("CustomApplication", "<tabs>Orders</tabs><tabs>standard-home</tabs>"),
    "settings/Case.settings-meta.xml": xml("CaseSettings", ""),
    "sharingRules/Order__c.sharingRules-meta.xml": xml("SharingRules", "<sharingCriteriaRules><fullName>ToSales</fullName><sharedTo><group>Sales</group></sharedTo></sharingCriteriaRules><sharingOwnerRules><fullName>Own</fullName><sharedTo><role>Boss</role></sharedTo></sharingOwnerRules>"),
    "duplicateRules/Account.Same.duplicateRule-meta.xml": xml("DuplicateRule", "<duplicateRuleMatchingRules><matchingRule>Account.Fuzzy</matchingRule></duplicateRuleMatchingRules>"),
    "matchingRules/Account.matchingRule-meta.xml": xml("MatchingRules", "<matchingRules><fullName>Fuzzy</fullName></matchingRules>"),
    "restrictionRules/Only.restrictionRule-meta.xml": xml("RestrictionRule", "<targetEntity>Order__c</targetEntity>"),
    "reports/Sales.report-meta.xml": xml("Report", "<reportType>Order__c</reportType><columns><field>Order__c.Status__c</field></columns><columns><field>AMOUNT</field></columns><filter><criteriaItems><column>Buyer__c</column></criteriaItems></filter>"),
    "dashboards/Top.dashboard-meta.xml": xml("Dashboard", "<leftSection><components><report>Folder/Sales</report></components></leftSection>"),
    "reportTypes/Orders.reportType-meta.xml": xml("ReportType", "<baseObject>Order__c</baseObject><sections><columns><field>Status__c</field></columns></sections>"),
    "installedPackages/ext.installedPackage-meta.xml": xml("InstalledPackage", "<versionNumber>1.2</versionNumber><namespace>ext</namespace>"),
    "bots/Agent/Agent.bot-meta.xml": xml("Bot", "<label>My agent</label><botUser>u@example</botUser>"),
    "bots/Agent/v1.botVersion-meta.xml": xml("BotVersion", "<conversationDefinition>Notify</conversationDefinition><genAiPlugins><genAiPlugin>Topic</genAiPlugin></genAiPlugins><planner><genAiPlannerBundle>Plan</genAiPlannerBundle></planner><conversationDefinitionPlanners><genAiPlannerName>Plan</genAiPlannerName></conversationDefinitionPlanners>"),
    "genAiPlugins/Topic.genAiPlugin-meta.xml": xml("GenAiPlugin", "<masterLabel>A topic</masterLabel><functions><functionName>Act</functionName></functions>"),
    "genAiFunctions/Act.genAiFunction-meta.xml": xml("GenAiFunction", "<invocableActionType>odd</invocableActionType><invocableActionName>Helper</invocableActionName>"),
    "genAiPlannerBundles/Plan.genAiPlannerBundle-meta.xml": xml("GenAiPlannerBundle", "<localTopics><localActions><fullName>Do</fullName><invocationTarget>Notify</invocationTarget><invocationTargetType>flow</invocationTargetType></localActions></localTopics>"),
    "promptTemplates/Mail.promptTemplate-meta.xml": xml("PromptTemplate", "<primaryObject>Order__c</primaryObject><x><relatedObject>Account</relatedObject></x><flexTemplateActionCalls><actionType>apex</actionType><actionName>Helper</actionName></flexTemplateActionCalls>"),
    "lwc/orderCard/orderCard.js": "import { LightningElement, wire } from 'lwc';\nimport save from '@salesforce/apex/OrderService.save';\nimport STATUS from '@salesforce/schema/Order__c.Status__c';\nimport HELLO from '@salesforce/label/c.Hello';\nimport child from 'c/orderLine';\nexport default class OrderCard extends LightningElement {\n    @wire(getRecord, {}) r;\n    connectedCallback() {\n    }\n}\n",
    "lwc/orderCard/orderCard.html": "<template><c-order-line></c-order-line><lightning-card></lightning-card></template>",
    "aura/OldCard/OldCard.cmp": '<aura:component controller="OrderService" extends="c:Base"><c:Child/></aura:component>',
    "aura/OldCard/OldCardController.js": '({\n  run : function(cmp) {\n    var a = cmp.get("c.save");\n  }\n})',
    "pages/Orders.page": '<apex:page standardController="Order__c" extensions="OrderService, Helper"><c:Box/></apex:page>',
    "components/Box.component": '<apex:component controller="Helper"></apex:component>',
    "docs/guide.md": "# Orders\n\nThe OrderService writes Order__c. See `Helper` for more.\n\n## Details\n\n```\nHelper.log\n```\n#### deep\n",
    "docs/logo.png": "x",
    "node_modules/lib/Skipped.cls": "public class Skipped { }",
    "ignored/Gone.cls": "public class Gone { }",
    "ignored/Kept.cls": "public class Kept { }",
    ".forceignore": "# rules\nignored/*.cls\n!ignored/Kept.cls\n",
}


def write_tree(root: Path) -> Path:
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="session")
def project(tmp_path_factory):
    return write_tree(tmp_path_factory.mktemp("project"))


@pytest.fixture(scope="session")
def built(spark, project, tmp_path_factory):
    from weftgraph.plans import pipeline

    out = str(tmp_path_factory.mktemp("out"))
    return pipeline.run(spark, str(project), out), out
